import base64
import random

import numpy as np
import pytest

from tidewatch.llm import token_counts as m


@pytest.fixture(scope="module")
def lib():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=m.model_path())


def test_query_equals_the_library(spark, sf, documents, lib):
    for r in m.query(spark, sf).collect():
        text = documents[r["doc_id"]]["text"] or ""
        assert r["n_tokens"] == len(lib.encode(text)) and r["n_bytes"] == len(text.encode())
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_random_texts_equal_the_library(lib):
    """Mixed scripts, space runs, marks, bytes outside the vocabulary, special strings, and texts longer than chunks and blocks."""
    rnd = random.Random(9)
    bits = ["the", "ing", "tion", " ", "  ", "    ", "\n", "\t", "▁", "▁▁", "é", "ß", "你", "好", "🙂", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "Ω", "ж", "aaaa", "0", "12", "==", "--", "zz", "q", "​", "﷽"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 60))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 3000, "ab" * 700 + " " + "你" * 900, "", " ", "\n"]
    machine = m.Transducer(m.model_path())
    assert machine.count(texts).tolist() == [len(lib.encode(t)) for t in texts]


@pytest.mark.parametrize("kind", ["han", "base64", "one letter", "digits", "mixed"])
def test_long_texts_without_spaces(lib, kind):
    """Five megabytes in chunks without a sure place: equal to the library, in few passes over the chunks."""
    rnd = random.Random(3)
    han = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生"
    text = {
        "han": lambda: "".join(rnd.choices(han, k=1_700_000)), "base64": lambda: base64.b64encode(rnd.randbytes(3_750_000)).decode(), "one letter": lambda: "a" * 5_000_000,
        "digits": lambda: "".join(rnd.choices("0123456789", k=5_000_000)), "mixed": lambda: "".join(rnd.choices([*han, "the", "ing", "==", "zz", "12"], k=2_000_000)),
    }[kind]()
    machine = m.Transducer(m.model_path())
    assert machine.count([text]).tolist() == [len(lib.encode(text))]
    assert machine.passes <= 12


def test_maps_of_states_that_do_not_meet_are_still_composed(lib, monkeypatch):
    """With a poor guess and no other guesses the scan asks for what it misses, chunk by chunk if need be."""
    monkeypatch.setattr(m, "WARM", 1)
    monkeypatch.setattr(m, "GUESSES", 0)
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcdefgh", k=9000)), "a" * 7001, "xyz" * 3000, "你好" * 2000 + " " + "0" * 5000]
    assert m.Transducer(m.model_path()).count(texts).tolist() == [len(lib.encode(t)) for t in texts]


def test_scan_reaches_what_follows():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        follows = np.where(rnd.random(n) < 0.8, np.minimum(np.arange(n) + rnd.integers(1, 4, n), n - 1), -1)
        follows[-1] = -1
        starts = rnd.random(n) < 0.2
        want = starts.copy()
        for i in range(n):
            if want[i] and follows[i] >= 0:
                want[follows[i]] = True
        assert (m.Transducer._scan(starts, follows) == want).all()


def test_small_blocks_and_a_small_table_change_nothing(lib, monkeypatch, documents):
    texts = [r["text"] or "" for r in documents.values()][:60]
    monkeypatch.setattr(m, "BLOCK", 1000)
    monkeypatch.setattr(m, "MAX_CELLS", 200_000)
    assert m.Transducer(m.model_path()).count(texts).tolist() == [len(lib.encode(t)) for t in texts]


def test_odd_rows(odd, nothing, lib):
    for r in m.count_tokens(odd).collect():
        assert r["n_tokens"] == len(lib.encode(r["text"] or "")) and r["n"] == -1
    assert m.count_tokens(nothing).collect() == []
