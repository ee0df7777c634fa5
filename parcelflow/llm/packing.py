"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Pieces of equal length are interchangeable, so the packing is planned on the table of piece counts by length: at most ``capacity``
rows, whatever the size of the corpus. The plan is a list of *patterns* (the lengths in a sequence, and how many sequences get them).
Each piece then takes the place that its rank among the pieces of its length points to. Ranks are counted in hashed blocks, so a length
that most documents share is no hot group.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .rows import core, map_slices, own_cache

CACHED_WORDS = 1_000_000
BLOCK_CHARACTERS = 1_000_000
#: What a byte, or the character it belongs to, is. Some engines take MAYBE for a blank, some don't: no cut depends on it.
OTHER, BLANK, MAYBE, MARK, ALNUM = range(5)


def _kinds() -> np.ndarray:
    """The kind of each character of one to three bytes, by its number."""
    kinds = np.full(1 << 16, OTHER, dtype=np.uint8)
    for kind, wanted in ((ALNUM, str.isalnum), (MAYBE, str.isspace), (MARK, string.punctuation.__contains__), (BLANK, " \t\n\v\f\r".__contains__)):
        kinds[[i for i in range(1 << 16) if wanted(chr(i))]] = kind
    return kinds


class WordTokenizer:
    """Token ids of whole texts, as the bytes of little-endian unsigned 32-bit ids.

    A byte-level BPE vocabulary merges inside the pieces alone that a pattern finds in a text, from left to right. So a text is cut at places
    where a piece must end, see ``cuts``; what lies between is encoded once and remembered. New words are encoded together, as one
    text, and told apart by their number of bytes. Texts are cut, and ids gathered, as arrays over a block of texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))  # a character stands for a byte
        self.kinds = _kinds()
        self.line_end = self.encode("\n").tobytes()
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where to cut the UTF-8 bytes ``data`` of texts that meet at ``bounds``, first and last place included.

        Of a run of blanks all but the last are a piece, and the last one is too, unless it is a space: that begins the next piece. A run at the
        end of a text is one piece. Letters and digits are apart from a mark behind them.
        """
        kinds = self.kinds[data]
        kinds[data >= 0x80] = OTHER
        for size, mask, lead in ((2, 0xE0, 0xC0), (3, 0xF0, 0xE0)):
            at = np.flatnonzero(data & mask == lead)
            if len(at):
                number = (data[at] & (0xFF ^ mask)).astype(np.int32)
                for k in range(1, size):
                    number = number << 6 | data[at + k] & 0x3F
                for k in range(size):
                    kinds[at + k] = self.kinds[number]
        blank = kinds == BLANK
        solid = ~blank & (kinds != MAYBE)
        last = np.zeros(len(data), dtype=bool)
        last[:-1] = blank[:-1] & solid[1:]
        last[bounds[bounds > 0] - 1] = False  # the next text doesn't count
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = blank[1:] & (solid[:-1] | last[1:]) | (kinds[1:] == MARK) & (kinds[:-1] == ALNUM)
        cut[1:] |= last & (data != 0x20)
        cut[bounds] = True
        return np.flatnonzero(cut)

    def ids(self, parts: list[str]) -> list[bytes]:
        """The ids of each of ``parts``, which are distinct; those of new ones are remembered."""
        words = self.words
        if len(words) > CACHED_WORDS:
            words.clear()
        known = list(map(words.get, parts))
        new = [i for i, ids in enumerate(known) if ids is None]
        if new:
            self.learn([parts[i] for i in new])
            for i in new:
                known[i] = words[parts[i]]
        return known

    def learn(self, parts: list[str]) -> None:
        """Remember the ids of ``parts``."""
        words = self.words
        spaced, bare = [], []
        for part in parts:
            if part[-1].isspace() or part[part[0] == " "].isspace():  # it would not be apart from others
                words[part] = self.encode(part).tobytes()
            else:
                (spaced if part[0] == " " else bare).append(part)
        if spaced or bare:
            ids = self.encode("".join(spaced) + "".join(["\n" + part for part in bare]))
            ends = np.cumsum([len(part.encode()) for part in spaced] + [len(part.encode()) + 1 for part in bare])
            cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)).tolist()]
            data = ids.tobytes()
            words.update((part, data[a:b]) for part, a, b in zip(spaced, cuts, cuts[1:]))
            cuts, skipped = cuts[len(spaced):], len(self.line_end)
            words.update((part, data[a + skipped:b]) for part, a, b in zip(bare, cuts, cuts[1:]))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; a block of texts at a time."""
        i = 0
        while i < len(texts):
            block, size = [], 0
            while i < len(texts) and size < BLOCK_CHARACTERS:
                block.append((texts[i] or "").encode())
                size += len(texts[i] or "")
                i += 1
            yield from self.block(block)

    def block(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text. They are cut together, and each distinct part is looked up once."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not len(data):
            yield from texts
            return
        bounds = np.cumsum([0, *map(len, texts)])
        places = self.cuts(data, bounds)
        found = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        known = self.ids(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = np.frombuffer(b"".join(known), dtype="<u4"), np.asarray(list(map(len, known))) // 4
        which = found.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - ends + counts, counts) + np.arange(ends[-1])]
        for a, b in pairwise(np.append(0, ends)[np.searchsorted(places, bounds)].tolist()):
            yield ids[a:b].tobytes()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
           with_tokens: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, tokens]): each document's ids and the end id, cut where they exceed ``capacity``.

    A longer document's first piece takes what is over whole pieces. A null or empty text is the end id alone.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", tokens binary" * with_tokens

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        encode = tokenizer(vocabulary)
        own_cache("tokens", _TOKENIZERS)
        rows = []
        for doc_id, ids in zip(part["doc_id"].array, encode(list(part["text"].array)), strict=True):
            ids += end
            n = len(ids) // 4
            head = n % capacity or min(n, capacity)
            bounds = [0, *range(head, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                piece = ids[4 * a:4 * b]
                rows.append((doc_id, k, a, b - a, zlib.crc32(piece), *([piece] if with_tokens else [])))
        return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["tokens"] * with_tokens])

    arrow = pa.schema([("doc_id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                       *[("tokens", pa.binary())] * with_tokens])
    # the id travels as text, so that nulls and any type survive pandas
    plain = core(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    return map_slices(plain, cut, schema, arrow).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit on counts by length: ([(length, times in a sequence)], number of sequences) for each pattern.

    A sequence is filled greedily, the longest fitting piece first. Then its smallest piece is replaced with the two unused pieces that
    fill its gap and that piece's place most tightly, if they fill more. What a pattern holds is taken as often as the counts allow, so
    the steps depend on the number of lengths and not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    patterns = []
    while lengths:
        pattern: dict[int, int] = {}
        gap = capacity
        while True:  # greedy: the longest that fits and is left
            k = bisect_left(lengths, gap + 1) - 1
            while k >= 0 and left[lengths[k]] <= pattern.get(lengths[k], 0):
                k -= 1
            if k < 0:
                break
            n = lengths[k]
            times = min(gap // n, left[n] - pattern.get(n, 0))
            if not pattern:
                times = 1  # the first piece opens the sequence; the rest is best fit
            pattern[n] = pattern.get(n, 0) + times
            gap -= n * times
        if gap and sum(pattern.values()) > 1:
            _two_for_smallest(pattern, left, lengths, gap)
        times = min(left[n] // c for n, c in pattern.items())
        patterns.append((sorted(pattern.items(), reverse=True), times))
        for n, c in pattern.items():
            left[n] -= c * times
            if not left[n]:
                lengths.pop(bisect_left(lengths, n))
    return patterns


def _two_for_smallest(pattern: dict[int, int], left: dict[int, int], lengths: list[int], gap: int) -> None:
    """Replace the smallest piece with two unused ones that fit the gap and its place more tightly, if there are any."""
    smallest = min(pattern)
    room = gap + smallest
    free = [n for n in lengths if n < room and left[n] > pattern.get(n, 0) - (n == smallest)]
    best, pair = smallest, None
    i, j = 0, len(free) - 1
    while i <= j:
        total = free[i] + free[j]
        if total > room:
            j -= 1
            continue
        if total > best and (i < j or left[free[i]] - pattern.get(free[i], 0) + (free[i] == smallest) >= 2):
            best, pair = total, (free[i], free[j])
        i += 1
    if pair:
        pattern[smallest] -= 1
        if not pattern[smallest]:
            del pattern[smallest]
        for n in pair:
            pattern[n] = pattern.get(n, 0) + 1


def place_table(patterns) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, times in a sequence, offset in it, and first sequence number of each pattern that uses it."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        offset = 0
        for n, c in pattern:
            table.setdefault(n, []).append((used.get(n, 0), c, offset, first))
            used[n] = used.get(n, 0) + c * times
            offset += n * c
        first += times
    return {n: tuple(np.asarray(x, dtype=np.int64) for x in zip(*rows, strict=True)) for n, rows in table.items()}


def pack(parts: DataFrame, capacity: int = 1024, block: int = 4096) -> DataFrame:
    """``parts`` (with ``doc_id, piece, length`` and any other columns) with ``sequence_id long`` and ``offset long``.

    Every row gets a place; rows that are equal get places of their own. Only the counts by length, at most ``capacity`` rows, reach the
    driver. ``parts`` is read twice and must not change between: pass a written table.
    """
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = place_table(plan_patterns(counts, capacity))
    blocks = max(64, sum(counts.values()) // block)
    own = parts.columns
    dealt = parts.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(blocks)))
    in_block = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece")))
    sizes = dealt.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = in_block.join(starts, ["length", "_block"]).select(*own, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), dtype=np.int64)
        ns, rs = length.to_numpy(), rank.to_numpy()
        for n in np.unique(ns):
            at = np.flatnonzero(ns == n)
            base, times, offset, first = table[int(n)]
            k = np.searchsorted(base, rs[at], side="right") - 1
            r = rs[at] - base[k]
            out[at, 0] = first[k] + r // times[k]
            out[at, 1] = offset[k] + r % times[k] * n
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    return ranked.withColumn("_place", placed("length", "_rank")).select(*own, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   with_tokens: bool = False) -> DataFrame:
    """Documents packed into as few sequences as best-two-fit finds: one row per piece, see ``pieces`` and ``pack``.

    Nulls and empty texts are pieces of one id, any length of text is cut, repeated rows are packed each for itself, an empty table
    gives no rows, other columns are left out. ``with_tokens`` adds the ids as little-endian unsigned 32-bit numbers.
    """
    return pack(materialize(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_tokens), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens array<long>, doc_offsets array<long>) from packed pieces with tokens."""
    def join(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids = np.frombuffer(b"".join(rows["tokens"]), dtype="<u4").astype(np.int64)
        return pd.DataFrame({"sequence_id": [key[0]], "tokens": [ids], "doc_offsets": [rows["offset"].to_numpy()]})
    return packed.select("sequence_id", "offset", "tokens").groupBy("sequence_id").applyInPandas(
        join, "sequence_id long, tokens array<long>, doc_offsets array<long>")
