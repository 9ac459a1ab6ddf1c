import zlib

import numpy as np
import pytest

from tidewatch.llm import packing as m


def check(rows, size=m.SEQUENCE):
    """Every sequence is gapless from 0 and fits."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(held)


def test_pieces_hold_the_library_ids(spark, sf, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(m.tokenizer_paths()[0])
    rows = m.query(spark, sf).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r
    assert by_doc.keys() == documents.keys()
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(documents[doc]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert [(p["start"], p["length"]) for _, p in sorted(pieces.items())] == m.cut(len(ids))
        for p in pieces.values():
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    assert check(rows) <= 1.01 * -(-sum(r["length"] for r in rows) // m.SEQUENCE) + 2


def test_cut():
    assert m.cut(1) == [(0, 1)] and m.cut(1024) == [(0, 1024)] and m.cut(2048) == [(0, 1024), (1024, 1024)]
    assert m.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


@pytest.mark.parametrize("shape", ["even", "short", "hot", "large", "none"])
def test_plan_places_every_piece_once(shape):
    rng = np.random.default_rng(6)
    counts = {
        "even": rng.integers(0, 9, 1025), "short": np.bincount(rng.geometric(0.05, 5000).clip(1, 1024), minlength=1025),
        "hot": np.bincount(np.concatenate([np.full(4000, 700), rng.integers(1, 1025, 3000)]), minlength=1025),
        "large": np.bincount(rng.integers(600, 1025, 500), minlength=1025), "none": np.zeros(1025, int),
    }[shape]
    counts[0] = 0
    plan = m.plan(counts)
    lengths = np.repeat(np.arange(1025), counts)
    ranks = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = m.place(lengths, ranks, plan) if len(lengths) else (lengths, lengths)
    n = check([{"sequence_id": s, "offset": o, "length": x} for s, o, x in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)])
    bound = max(-(-int(lengths.sum()) // 1024), int(counts[513:].sum()))
    assert n == int(plan["n"]) <= 1.01 * bound + 2


def test_fit_is_non_negative_least_squares():
    """On a small case, against the optimality conditions."""
    counts = np.array([0, 6, 3, 0, 5, 2, 1, 4, 0], float)
    shapes = m.patterns(counts.astype(int))
    x = m.fit(counts, shapes, steps=20_000)
    weight = np.clip(np.arange(9) / 2, 0.1, 1.0) ** 2
    weight[0] = 0
    used = sum(np.bincount(shapes[:, c], weights=x, minlength=9) for c in range(3))
    slope = (weight * (used - counts))[shapes].sum(axis=1)
    assert (x >= 0).all() and slope.min() > -1e-3 and np.abs(slope[x > 1e-6]).max(initial=0) < 1e-3


def test_special_strings_are_the_tokenizers():
    from tokenizers import Tokenizer

    paths = m.tokenizer_paths()
    tokenizer = Tokenizer.from_file(paths[0])
    for text in ["a<|endoftext|>b", "<|endoftext|>", "  spaces   \n\n x", "né 你好 🙂", "x" * 5000, " " * 5000]:
        assert m.encode(text, paths) == tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_rows(odd, nothing, spark):
    rows = m.pack(odd, keep_ids=True).collect()
    assert {r["doc_id"] for r in rows} == set(range(9)) and all(len(r["ids"]) == r["length"] for r in rows)
    assert [r["length"] for r in rows if r["doc_id"] == 0] == [1]
    check(rows)
    assert m.pack(nothing).collect() == []
    twice = m.pack(odd.unionByName(odd).withColumn("doc_id", odd["doc_id"] * 0)).collect()
    assert len(twice) == 2 * len(rows) and check(twice)
