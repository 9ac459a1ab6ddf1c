"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

In byte-pair encoding the last token of a text's encoding is fixed by the text, and a token sequence is the encoding
exactly when all its neighbours are compatible, that is, when the encoding of the two joined is the two. So reading
one more character needs little memory: the places at which a token that is still open may begin, the token that ends
at each of them, and how many tokens fewer there were. This finite memory is the state of a deterministic transducer;
each transition carries the change of the token count. States and transitions are compiled when a text first needs
them and kept by the worker, up to a bound on the table after which it begins anew.

No token has a space mark after another character, and characters outside the vocabulary become their UTF-8 bytes,
so the state after either does not depend on what came before. Texts are laid out in chunks of equal length that
step through the table side by side. From the first such place on, a chunk's state map is constant. Of chunks without one
(scripts without spaces, encoded data) maps are built for the entry states that may be reached, and composed by a parallel
prefix scan in doubling steps, so that long runs of them take passes in the number of their reachable states and not of
chunks. With every chunk's entry state known, a last pass counts the chunks' heads.

Defined cases: null and empty texts have no tokens; text of any length is read in blocks of bounded size; strings
of special tokens are ordinary text, as the library treats them; repeated rows are each counted; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, table

LIMIT = 4096
SPACE = "▁"
CHUNK = 256
#: Characters at the end of the chunk before that an entry state is guessed from, and passes in which all exits are tried as entries;
#: so many states at most are tried in all chunks at once.
WARM, GUESSES, SPREAD = 64, 4, 64
BLOCK = 2_000_000
MAX_CELLS = 32_000_000
#: Classes of characters: padding, a space mark that follows another character, then 1 to 4 bytes outside the vocabulary.
_PAD, _RESET, _BYTES = 0, 1, 1
_FIRST_CLASS = 6
_WAIT, _ROOT = 0, 1


class Transducer:
    """Counts tokens as the vocabulary's library does, without its begin and end tokens."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=model_path)
        ids = range(lib.get_piece_size())
        plain = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.rank = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        assert not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank), "a token crosses a word's start"
        assert all(c in self.rank for p in self.rank for c in p), "a character is only inside tokens"
        self.open = {p[:n] for p in self.rank for n in range(1, len(p))}
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.char_class = np.full(0x110000, -1, dtype=np.int32)
        points = np.arange(0x110000)
        for n, (low, high) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000)), 1):
            self.char_class[low:high] = _BYTES + n
        known = np.array(sorted(ord(p) for p in self.rank if len(p) == 1))
        self.char_class[points[known]] = -1  # gets a class when first seen
        self.chars: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.memory: list[tuple] = []
        self.width = -(-(_FIRST_CLASS + len(self.chars) + 8) // 16) * 16
        self.next, self.emit = self._rows(0, 1024)
        self._state(("wait", ()))
        self._state(("", ((0, None, 0),)))
        self.next[_WAIT] = _WAIT
        self.next[_WAIT, _RESET] = -1
        self.next[_WAIT, _BYTES + 1 : _BYTES + 5] = _ROOT

    def _rows(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of new states: padding stays, bytes lead to the root, all else is not compiled yet."""
        to, out = np.full((n, self.width), -1, dtype=np.int32), np.zeros((n, self.width), dtype=np.int8)
        to[:, _PAD] = np.arange(first, first + n)
        to[:, _BYTES + 1 : _BYTES + 5] = _ROOT
        out[:, _BYTES + 1 : _BYTES + 5] = (1, 2, 3, 4)
        return to, out

    def _state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.memory)
            if found == len(self.next):
                more = self._rows(found, max(1024, found // 2))
                self.next, self.emit = np.concatenate([self.next, more[0]]), np.concatenate([self.emit, more[1]])
            self.memory.append(key)
        return found

    def encode(self, text: str) -> list[str]:
        """Plain byte-pair encoding of a short text, the best-ranked pair first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], np.inf))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _compatible(self, before: str | None, token: str) -> bool:
        """Whether the token stands by itself, and stays when the one before it is joined to it."""
        key = (before, token)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.encode(token) == [token] and (before is None or self.encode(before + token) == [before, token])
            self.fits[key] = found
        return found

    def _compile(self, state: int, cls: int) -> None:
        """Fills in one transition.

        A state's key is the text that open tokens may begin in, and for each place where one may begin: where it
        is, the last token that ends there, and the count there less the count so far.
        """
        char = SPACE if cls == _RESET else self.chars[cls - _FIRST_CLASS]
        text, places = self.memory[_ROOT if cls == _RESET else state]
        text += char
        token, count, kept = None, 0, []
        for place in places:
            n, before, c = place
            rest = text[n:]
            if token is None and rest in self.rank and self._compatible(before, rest):
                token, count = rest, c + 1
            if rest in self.open:
                kept.append(place)
        shift = kept[0][0] if kept else len(text)
        key = (text[shift:], (*[(n - shift, before, c - count) for n, before, c in kept], (len(text) - shift, token, 0)))
        target = self._state(key)
        self.next[state, cls] = target
        self.emit[state, cls] = count

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Classes of code points; new characters get one."""
        found = self.char_class[codes]
        if (found < 0).any():
            for c in np.unique(codes[found < 0]).tolist():
                self.char_class[c] = _FIRST_CLASS + len(self.chars)
                self.chars.append(chr(c))
            if _FIRST_CLASS + len(self.chars) > self.width:
                self._clear()
            found = self.char_class[codes]
        space = self.char_class[ord(SPACE)]
        if space >= 0:
            first = found == space
            first[1:] &= found[:-1] != space
            found[first] = _RESET
        return found

    def _step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.width
        at = state * width + cls
        to = self.next.ravel().take(at)
        if to.min(initial=0) < 0:
            for one in np.unique(at[to < 0]).tolist():
                self._compile(*divmod(one, width))
            to = self.next.ravel().take(at)
        return to, self.emit.ravel().take(at)

    def run(self, cls: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Count changes at every character of a block that is entered in a state, and the state after it."""
        lanes = -(-len(cls) // CHUNK)
        grid = np.zeros(lanes * CHUNK, dtype=np.int32)
        grid[: len(cls)] = cls
        grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
        fixed = (grid >= _RESET) & (grid < _FIRST_CLASS)
        head = np.where(fixed.any(axis=0), fixed.argmax(axis=0), CHUNK)  # characters before the state is sure
        out = np.zeros((CHUNK, lanes), dtype=np.int8)
        state = np.full(lanes, _WAIT, dtype=np.int64)
        for k in range(CHUNK):
            state, out[k] = self._step(state, grid[k])
            state = state.astype(np.int64)
        last = np.concatenate(([entry], state))  # exit states: constant maps of chunks with a sure place
        free = np.flatnonzero(head == CHUNK)
        if len(free):
            last[free + 1] = self._composed(grid, free, last)
        todo = np.flatnonzero(head > 0)
        order = np.argsort(-head[todo], kind="stable")
        todo = todo[order]
        state, n = last[todo], head[todo]
        for k in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -k, side="left"))
            state[:live], out[k, todo[:live]] = self._step(state[:live], grid[k, todo[:live]])
        return out.T.ravel()[: len(cls)], int(last[-1])

    def _exits(self, grid: np.ndarray, lanes: np.ndarray, entries: np.ndarray, first: int = 0) -> np.ndarray:
        """States after chunks that are entered in the given states, all side by side."""
        state = entries.astype(np.int64)
        for k in range(first, CHUNK):
            state = self._step(state, grid[k, lanes])[0].astype(np.int64)
        return state

    def _composed(self, grid: np.ndarray, free: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Exit states of the chunks without a sure place, by composing their state maps in a parallel prefix scan.

        A map is built for the entry states that may be reached: the state that the end of the chunk before leads to, and
        exits of that chunk's own map. What the scan reaches and no map has yet is added, and it scans again.
        """
        is_free = np.zeros(grid.shape[1] + 1, dtype=bool)
        is_free[free] = True
        after_known = ~is_free[free - 1] | (free == 0)
        entry = np.empty(len(free), dtype=np.int64)
        entry[after_known] = last[free[after_known]]
        guess = free[~after_known]
        entry[~after_known] = self._exits(grid, guess - 1, np.full(len(guess), _ROOT), CHUNK - WARM)
        lane, sure = free, after_known
        lanes, entries, exits = (np.zeros(0, dtype=np.int64) for _ in range(3))
        starts = np.zeros(0, dtype=bool)
        self.passes = 0
        while True:
            lanes, entries, starts = np.concatenate([lanes, lane]), np.concatenate([entries, entry]), np.concatenate([starts, sure])
            exits = np.concatenate([exits, self._exits(grid, lane, entry)])
            self.passes += 1
            order = np.lexsort((entries, lanes))
            lanes, entries, exits, starts = lanes[order], entries[order], exits[order], starts[order]
            span = int(max(entries.max(), exits.max())) + 1
            key, wanted = lanes * span + entries, (lanes + 1) * span + exits
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            there, goes_on = key[at] == wanted, is_free[lanes + 1]
            reached = self._scan(starts, np.where(there & goes_on, at, -1))
            wanting = reached & goes_on & ~there
            if not wanting.any():
                break
            # At first any exit may be an entry; then what the scan came to, in the next chunk and, as repeated text leads
            # back to few states, in all chunks where these are few.
            new = wanted[goes_on & ~there] if self.passes <= GUESSES else wanted[wanting]
            few = np.unique(exits[wanting])
            if self.passes > GUESSES and len(few) <= SPREAD:
                new = np.concatenate([new, (guess[:, None] * span + few).ravel()])
            new = np.setdiff1d(new, key)
            lane, entry = np.divmod(new, span)
            sure = np.zeros(len(new), dtype=bool)
        found = np.empty(grid.shape[1], dtype=np.int64)
        found[lanes[reached]] = exits[reached]
        return found[free]

    @staticmethod
    def _scan(starts: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """What is reached from the starts when each place leads to the one it names (-1: none), in doubling steps."""
        reached, jump = starts.copy(), np.append(follows, -1)
        step = 1
        while step <= len(starts):
            to = jump[np.flatnonzero(reached)]
            reached[to[to >= 0]] = True
            jump = jump[jump]  # -1 names the last place, which leads nowhere
            step *= 2
        return reached

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        total = np.zeros(len(texts), dtype=np.int64)
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < BLOCK):
                size += len(texts[last]) + 1
                last += 1
            part = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts[first:last]]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            owner = np.repeat(np.arange(first, last), [len(p) for p in part])
            state = _ROOT
            starts = np.zeros(len(codes), dtype=bool)
            starts[np.flatnonzero(np.diff(owner, prepend=-1))] = True
            for k in range(0, len(codes), BLOCK):
                entry = self.memory[state]
                if self.next.size > MAX_CELLS:
                    self._clear()
                cls = self.classes(codes[max(0, k - 1) : k + BLOCK])[k > 0 :]
                state = self._state(entry)
                own = starts[k : k + BLOCK]
                cls[own] = _RESET
                change, state = self.run(cls, state)
                total += np.bincount(owner[k : k + BLOCK], weights=change, minlength=len(texts)).astype(np.int64)
            first = last
        return total


@cache
def _transducer(model_path: str) -> Transducer:
    return Transducer(model_path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Token count of a text column."""
    path = path or model_path()

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _transducer(path)
        for texts in batches:
            yield pd.Series(machine.count(texts.fillna("").tolist()), dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit. One pass without a shuffle."""
    small_batches(docs.sparkSession)
    out = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col(text), path)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
