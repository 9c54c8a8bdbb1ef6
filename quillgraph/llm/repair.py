"""Operator 9: token ids as shards in binary form, compressed by a Re-Pair grammar.

Texts become ids; a shard is the ids of some megabytes of text. The most frequent pair of neighbours is replaced by a
nonterminal, again and again, until no pair occurs ``least`` times (2: until none repeats) without overlapping itself
(Larsson and Moffat, 1999). A round replaces all pairs with at least ``share`` of the highest count, or the most frequent that
make up ``portion`` of all places if they are more, and of those that share a code the more frequent one; so a round is a
few numpy passes. On shards of 2 MB the grammar is less than 1 % larger than with one count a round. No pair reaches over
a document's end. A shard stores its rules, how many ids every nonterminal expands to, its codes, and each document's
ends in codes and ids; so any range of ids of any document is decoded from the codes that cover it alone.

Codes take 2, 3 or 4 bytes, as the number of names asks. Nothing is shuffled, and a shard's work is bounded by its size,
whatever it holds.

Edge cases: a null text is kept as null (its count is -1), an empty one as no ids; null doc_ids and rows that repeat are
stored as they come; an empty table gives no shards; other columns are unread; a text of more than a shard's size is a
shard of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidy
from .tokens import SLICE, VOCABULARY, encoding, tokenizer
from .words import slices

LEAST, SHARE, PORTION = 2, 0.3, 0.1
SHARD = "shard long, doc_ids array<long>, n_tokens array<int>, code_ends array<int>, first_code int, width int, rules binary, expansions binary, codes binary"


def _order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits, sorted, and the places they had. Sorting numbers beats sorting places, where both fit in one."""
    size = max(1, int(len(key)).bit_length())
    if bits + size > 64:
        order = np.argsort(key)
        return key[order], order
    both = (key << np.uint64(size)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return both >> np.uint64(size), (both & np.uint64((1 << size) - 1)).astype(np.int64)


def grammar(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST, share: float = SHARE, portion: float = PORTION) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (a pair of codes each), expansion lengths of the nonterminals, codes, and the documents' ends in codes.

    ``pair`` holds the number of the pair that begins at each place, -1 if it can't repeat. A pair that occurs once never
    does so again, for a rule only makes pairs of its own name; so only places beside new names are ever sorted anew."""
    end = np.uint32(1 << 31)  # the mark of a document's last code
    seq = ids.astype(np.uint32)
    seq[ends[1:][np.diff(ends) > 0] - 1] |= end
    rules: list[np.ndarray] = []
    made, turn = 0, 0
    pair = np.full(len(seq), -1, np.int32)
    keys = np.zeros(0, np.uint64)
    fresh = np.arange(len(seq))
    while len(seq) > 1:
        fresh = fresh[seq[fresh] < end]
        if len(fresh):
            bits = int(first + made).bit_length()
            key, order = _order((seq[fresh].astype(np.uint64) << np.uint64(bits)) | (seq[fresh + 1] & ~end), 2 * bits)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            again = ~new
            again[:-1] |= again[1:]
            fresh, key = fresh[order[again]], key[again]  # the others occur once, for all their places are fresh
            new = new[again]
            pair[fresh] = np.cumsum(new, dtype=np.int32) + np.int32(len(keys) - 1)
            key = key[new]
            keys = np.concatenate((keys, (key >> np.uint64(bits) << np.uint64(32)) | (key & np.uint64((1 << bits) - 1))))
        live = np.flatnonzero(pair >= 0)
        own = pair[live]
        # A pair of equals may overlap itself: of a run, every second place counts.
        joins = own[1:] == own[:-1]
        joins &= live[1:] == live[:-1] + 1
        again = np.flatnonzero(joins) + 1
        if len(again):
            begin = np.flatnonzero(np.concatenate(([True], again[1:] != again[:-1] + 1)))
            odd = again[(np.arange(len(again)) - np.repeat(begin, np.diff(np.append(begin, len(again))))) % 2 == 0]
            even = np.ones(len(live), bool)
            even[odd] = False
            live, own = live[even], own[even]
        count = np.bincount(own, minlength=len(keys))
        top = int(count.max()) if len(count) else 0
        if top < least:
            break
        # Pairs of at least ``share`` of the highest count, or so many as make up ``portion`` of all places.
        held = np.cumsum(np.bincount(count, count)[::-1])[::-1]
        enough = len(held) - int(np.searchsorted(held[::-1], portion * len(live))) - 1
        chosen = count >= max(least, min(share * top, enough))
        mine = chosen[own]
        at, own_at = live[mine], own[mine]
        turn += 1
        if turn % 4 == 0:
            pair[live[(count < least)[own]]] = -1
        # Of chosen pairs that share a code the more frequent goes first; of equally frequent ones the greater number.
        rank = (count[own_at] << 32) | own_at
        touch = at[1:] == at[:-1] + 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(touch & (rank[:-1] > rank[1:]))
        wins[:-1] &= ~(touch & (rank[1:] > rank[:-1]))
        at, own = at[wins], own_at[wins]
        used = np.bincount(own, minlength=len(keys))
        named = np.flatnonzero(used >= least)  # the pair of the highest rank is always among them
        name = np.zeros(len(keys), np.uint32)
        name[named] = first + made + np.arange(len(named))
        made += len(named)
        rules.append(np.stack([keys[named] >> np.uint64(32), keys[named] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        code = name[own]
        at, code = at[code > 0], code[code > 0]
        seq[at] = code | (seq[at + 1] & end)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        pair[at] = -1
        pair[at[at > 0] - 1] = -1
        seq, pair = seq[keep], pair[keep]
        at -= np.arange(len(at))  # where the new names are now; what stands before them begins another pair, too
        mark = np.zeros(len(seq), bool)
        mark[at] = True
        mark[at[at > 0] - 1] = True
        fresh = np.flatnonzero(mark)
        pair[fresh] = -1
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    expansion = np.ones(first + len(table), np.int32)
    at = first
    for part in rules:  # a round's rules are of names of earlier ones
        expansion[at : at + len(part)] = expansion[part[:, 0]] + expansion[part[:, 1]]
        at += len(part)
    code_ends = np.zeros(len(ends), np.int64)
    here = np.flatnonzero(seq >= end) + 1
    code_ends[1:] = np.concatenate(([0], here))[np.cumsum(np.diff(ends) > 0)] if len(ends) > 1 else 0
    return table, expansion[first:], seq & ~end, code_ends


def packed(codes: np.ndarray, width: int) -> bytes:
    """Codes in ``width`` bytes each, the low byte first."""
    return np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u4").reshape(-1)


def expand(codes: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that codes stand for."""
    seq = codes.astype(np.int64)
    while True:
        high = seq >= first
        if not high.any():
            return seq.astype(np.int32)
        size = 1 + high
        out = np.repeat(seq, size)
        at = np.cumsum(size) - size
        pair = rules[seq[high] - first]
        out[at[high]], out[at[high] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(row["codes"], row["width"]), unpacked(row["rules"], row["width"]).reshape(-1, 2), np.frombuffer(row["expansions"], np.int32)


def document(row, k: int, start: int = 0, stop: int | None = None) -> np.ndarray | None:
    """Ids start..stop-1 of the shard's k-th document; only the codes that cover them are expanded."""
    if row["n_tokens"][k] < 0:
        return None
    width = row["width"]
    codes = unpacked(row["codes"][width * (row["code_ends"][k - 1] if k else 0) : width * row["code_ends"][k]], width)
    rules, expansion = unpacked(row["rules"], width).reshape(-1, 2), np.frombuffer(row["expansions"], np.int32)
    stop = row["n_tokens"][k] if stop is None else min(stop, row["n_tokens"][k])
    size = np.ones(len(codes), np.int64)
    high = codes >= row["first_code"]
    size[high] = expansion[codes[high].astype(np.int64) - row["first_code"]]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = start - (ends[a - 1] if a else 0)
    return expand(codes[a:b], rules, row["first_code"])[skip : skip + max(0, stop - start)]


def shards(docs: DataFrame, path: str = VOCABULARY, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """One row a shard, with the columns of SHARD."""

    def each(batches):
        t, first = tokenizer(path), encoding(path).n_vocab
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            null = np.asarray(batch.column("text").is_null())
            for part in slices(batch.column("text"), SLICE):
                ids, ends = t.encode(part)
                rules, expansion, codes, code_ends = grammar(ids, ends, first, least, share)
                width = 2 if first + len(rules) <= 1 << 16 else 3 if first + len(rules) <= 1 << 24 else 4
                n = np.where(null[part.lo : part.hi], -1, np.diff(ends))
                own = batch.column("doc_id").slice(part.lo, part.hi - part.lo)
                row = [number, own, n, code_ends[1:], first, width, packed(rules.reshape(-1), width), expansion.astype(np.int32).tobytes(), packed(codes, width)]
                one = np.array([0, len(n)], np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(one), x) for x in (own, pa.array(row[2].astype(np.int32)), pa.array(row[3].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *lists, pa.array([row[4]], pa.int32()), pa.array([row[5]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[6:])], [c.split()[0] for c in SHARD.split(", ")])
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(each), SHARD)


def decode(sharded: DataFrame) -> DataFrame:
    """(doc_id, ids) of all documents of all shards."""

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, rules, _ = _arrays(row)
                ids = expand(codes, rules, row["first_code"])
                n = np.array(row["n_tokens"], np.int64)
                ends = np.concatenate(([0], np.cumsum(np.maximum(n, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(n < 0, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], ["doc_id", "ids"])

    return sharded.mapInArrow(tidy(each), "doc_id long, ids array<int>")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
