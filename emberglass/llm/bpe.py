"""BPE encoding and decoding with a public tokenizer file, and tree concatenation for long texts.

White space always ends a piece, so the runs between are encoded by themselves, each once per worker process, and the
results are strung together. Where the file's normalizer and pre-tokenizer are the ones known here, runs of Latin
characters are lower-cased and split by a pattern of the same meaning and only the pieces go to the library's model;
all other runs go through the whole library.

A text of more than LEAF characters is halved, regardless of what stands at the cut, down to leaves of LEAF characters.
Leaves for the library are encoded in parallel, by THREADS threads: it works outside the interpreter's lock. Leaves of
Latin characters only are look-ups under that lock, which threads took 2.1 times the CPU time for; they are encoded in
turn. Then halves are joined upwards: a window around the cut is encoded again and grown until its first and its last tokens agree
with those of both sides, in ids and in places. Of two encodings that share tokens at the same places, the one may go
on where the other stops, so the joined ids are those of the whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberglass.llm.text import map_batches

#: Characters of a text that is encoded without cutting.
LEAF = 8192
#: Characters on either side of a cut in the first window, and atoms (below) that have to agree on either side.
REACH, AGREE = 48, 3
#: Pieces that a worker process keeps in either of two generations, other runs that it keeps, the length up to which they
#: are kept, runs per library call, and threads that encode leaves.
KEPT_PIECES, KEPT_RUNS, KEPT_LENGTH, CALL, THREADS = 300_000, 50_000, 64, 10_000, 4
_RUN = re.compile(r"[^\x20\x09-\x0D]+")


#: What is alike for all characters below U+0180 but one whether the library or this module does it.
_HARD = re.compile("[^\x00-\u012f\u0131-\u017f]")
_KINDS = {k: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
_SPACES = "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_KINDS['L']}]+|[{_KINDS['N']}]|[^{_SPACES}{_KINDS['L']}{_KINDS['N']}]+")
#: For each character below U+0180: 0 white space, 1 letter, 2 digit, 3 other.
_CLASS = np.array([0 if re.match(f"[{_SPACES}]", chr(c)) else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x180)], np.uint8)
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: Starts, ends (characters) and ids of successive parts of a text.
Atoms = tuple[list[int], list[int], list[bytes]]


class _Known(dict):
    """The ids of pieces, worked out when first asked for; those not asked for since two fillings are forgotten."""

    def __init__(self, size: int, find: Callable[[str], bytes]):
        self.size, self.find, self.old = size, find, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        self[key] = found
        return found

    def thin(self) -> None:
        if len(self) > self.size:
            self.old = {k: v for k, v in self.items() if len(k) <= KEPT_LENGTH}
            self.clear()


def _byte_level() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Codec:
    """One tokenizer file's encoder and decoder. Special tokens in a text are what the library takes them for."""

    def __init__(self, path: str, leaf: int = LEAF, reach: int = REACH):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.leaf, self.reach = leaf, reach
        config = json.loads(self.lib.to_str())
        steps = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.latin = (
            (config["normalizer"] or {}).get("normalizers") == _NORMALIZERS
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": _SPLIT}
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
        )
        self.special = [x["content"] for x in config["added_tokens"]]
        self.hard = re.compile("|".join([_HARD.pattern, *map(re.escape, self.special)]) if self.latin else r"(?s:.)")
        self.model, self.bytes = self.lib.model, _byte_level()
        self._pieces, self._runs = _Known(KEPT_PIECES, self._piece), {}
        self._threads = ThreadPoolExecutor(THREADS)

    def _easy(self, text: str) -> bool:
        """Whether self.hard finds nothing; the commonest cases are told without its search."""
        if self.latin and not any(x in text for x in self.special):
            if text.isascii():
                return True
            try:
                text.encode("latin-1")
                return True
            except UnicodeEncodeError:
                pass
        return not self.hard.search(text)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalpha() else "".join(map(self.bytes.__getitem__, piece.encode()))
        return pack([t.id for t in self.model.tokenize(shown)])

    def encode_all(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        self._pieces.thin()
        if len(self._runs) > KEPT_RUNS:
            self._runs.clear()
        known, easy, leaf = self._pieces.__getitem__, self._easy, self.leaf
        return [self.encode_tree(text) if len(text) > leaf or not easy(text) else b"".join(map(known, _PIECE.findall(text.lower()))) for text in batch]

    def decode_all(self, batch: list[bytes]) -> list[str]:
        return self.lib.decode_batch([np.frombuffer(x, "<u4").tolist() for x in batch], skip_special_tokens=False)

    def _tokens(self, piece: str, at: int) -> Atoms:
        """The tokens of a long piece of Latin characters that stands at a place."""
        raw = piece.encode()
        shown = [self.bytes[b] for b in raw]
        before = [at]  # characters that begin before each byte of what the model sees, and before its end
        for b, c in zip(raw, shown):
            before += [before[-1] + (b & 0xC0 != 0x80)] * len(c.encode())
        found = self.model.tokenize("".join(shown))
        return [before[t.offsets[0] + 1] - 1 for t in found], [before[t.offsets[1]] for t in found], [pack([t.id]) for t in found]

    def _latin(self, lowered: str, a: int, b: int) -> Atoms:
        part = lowered[a:b]
        if "'" in part:  # it may begin a piece with the letters after it
            found = [(m.start() + a, m.end() + a) for m in _PIECE.finditer(part)]
            starts, ends = map(list, zip(*found)) if found else ([], [])
        else:  # a piece ends where the class changes, and after each digit
            kind = np.zeros(b - a + 2, np.uint8)
            kind[1:-1] = _CLASS[np.frombuffer(part.encode("utf-16-le"), "<u2")]
            begins = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            starts = (np.flatnonzero(begins & (kind[1:] > 0)) + a).tolist()
            ends = (np.flatnonzero(begins & (kind[:-1] > 0)) + a).tolist()
        pieces = _PIECE.findall(part)
        if not pieces or max(map(len, pieces)) <= KEPT_LENGTH:
            return starts, ends, list(map(self._pieces.__getitem__, pieces))
        out: Atoms = ([], [], [])
        for piece, x, y in zip(pieces, starts, ends):
            for all_of, some in zip(out, ([x], [y], [self._pieces[piece]]) if len(piece) <= KEPT_LENGTH else self._tokens(piece, x)):
                all_of += some
        return out

    def _by_library(self, text: str, a: int, b: int) -> Atoms:
        """Run by run; a run with other characters than Latin goes to the library as it is."""
        runs = [(m.group(), m.start()) for m in _RUN.finditer(text, a, b)]
        whole: dict[str, Atoms | None] = {r: self._runs.get(r) for r, _ in runs if self.hard.search(r)}
        new = [r for r, known in whole.items() if known is None]
        for k in range(0, len(new), CALL):
            for run, e in zip(new[k : k + CALL], self.lib.encode_batch(new[k : k + CALL], add_special_tokens=False)):
                if len(run) <= KEPT_LENGTH:
                    whole[run] = self._runs[run] = ([0], [len(run)], [pack(e.ids)])
                else:
                    whole[run] = ([x for x, _ in e.offsets], [y for _, y in e.offsets], [pack([i]) for i in e.ids])
        out: Atoms = ([], [], [])
        for run, at in runs:
            starts, ends, ids = whole.get(run) or self._latin(run.lower(), 0, len(run))
            for all_of, some in zip(out, ([x + at for x in starts], [y + at for y in ends], ids)):
                all_of += some
        return out

    def atoms(self, text: str, a: int, b: int, lowered: str | None = None) -> Atoms:
        """text[a:b] by itself, as atoms at their places in text: short pieces and runs whole, long ones by token.

        lowered: the text lower-cased, if all of it is of easy characters.
        """
        if lowered is not None:
            return self._latin(lowered, a, b)
        part = text[a:b]
        if self.hard.search(part):
            return self._by_library(text, a, b)
        starts, ends, ids = self._latin(part.lower(), 0, b - a)
        return [x + a for x in starts], [y + a for y in ends], ids

    def encode_tree(self, text: str) -> bytes:
        """Ids of a text of any length; none for the empty text."""
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]) if b - a > self.leaf)})
        lowered = text.lower() if self._easy(text) else None
        each = self._threads.map if lowered is None else map
        parts = list(each(lambda ab: self.atoms(text, *ab, lowered), zip(cuts, cuts[1:])))
        while len(parts) > 1:
            joined = [self._join(text, lowered, parts[k], parts[k + 1], cuts[k], cuts[k + 1], cuts[k + 2]) for k in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(joined) * 2 :]
            cuts = [*cuts[:-1:2], cuts[-1]]
        return b"".join(parts[0][2])

    def _join(self, text: str, lowered: str | None, left: Atoms, right: Atoms, low: int, cut: int, high: int) -> Atoms:
        reach = self.reach
        while True:
            a = bisect_left(left[0], cut - reach)  # first atom of the left side in the window
            b = bisect_right(right[1], cut + reach)  # first of the right side beyond it
            begin = low if a == 0 or cut - reach <= low else left[0][a] if a < len(left[0]) else cut - reach
            end = high if b == len(right[0]) or cut + reach >= high else right[1][b - 1] if b else cut + reach
            window = self.atoms(text, begin, end, lowered)
            n = len(window[0])
            # what is kept of the left side and where the window goes on; where the window ends and the right side goes on
            head = (0, 0) if begin == low else self._agree(left, a, len(left[0]), window, range(0, n - AGREE + 1))
            tail = (len(right[0]) - AGREE, n - AGREE) if end == high else self._agree(right, 0, b, window, range(n - AGREE, -1, -1))
            if head and tail:
                (keep, first), (on, last) = head, tail
                if first <= last + AGREE:
                    return tuple(x[:keep] + w[first : last + AGREE] + y[on + AGREE :] for x, w, y in zip(left, window, right))
            reach *= 2

    @staticmethod
    def _agree(side: Atoms, a: int, b: int, window: Atoms, order: range) -> tuple[int, int] | None:
        """(place in the side, place in the window) of the first AGREE atoms, in the window's order, that both have."""
        where = {x: k for k, x in enumerate(zip(*(c[a:b] for c in side)), a)}
        found = list(zip(*window))
        for i in order:
            k = where.get(found[i])
            if k is not None and k + AGREE <= b and all(where.get(found[i + d]) == k + d for d in range(1, AGREE)):
                return k, i
        return None


@lru_cache(maxsize=2)
def codec(path: str, leaf: int = LEAF, reach: int = REACH) -> Codec:
    """One per worker process, so that what it has learnt is kept from task to task."""
    return Codec(path, leaf, reach)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Rows (doc_id long, ids binary) for every row: the text's ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Null ids and repeated rows stay as they are. Other columns are not looked at.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(path, leaf).encode_all([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with the library's text of the ids, special tokens included; null ids give the empty text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = codec(path).decode_all([x or b"" for x in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), each, "doc_id long, ids binary, text string")
