"""Operator 7: exact self-join of documents by the Jaccard similarity of their word n-grams (token-group matrix).

A document's tokens are the distinct hashes of its runs of ``n`` plain words (letters and digits, ASCII case folded);
of fewer words, the one run of them all. Two documents are linked if |a & b| / |a | b| >= ``threshold``. The result is one
row for each linked document: its class (the least doc_id that links lead to, over any number of steps) and how many
links it has. Copies are never expanded into pairs, and no link between different texts is lost.

1. What is joined are distinct token sets, told apart by a 64-bit signature; a task sends the tokens of each set once,
   however many copies it meets. Tokens go to token buckets under a short name of their set (task, 32 bits of signature),
   as the signature would be most of an entry where buckets are many. Of a set's names, one for each task that met it,
   the least is its owner. Tokens with two names or more go to the owner with that number, renumbered in their bucket;
   those that no other set has are dropped there. A set with fewer than threshold * size left joins nothing.
2. Sets are partitioned into groups of like ones: same least token hash, same size class. The token-group matrix is
   the union of the members' prefixes (rarest tokens first; size - ceil(t size) + l of them). A group can hold a
   partner of q only if q's prefix shares at least l tokens with that union (the extended prefix bound) and sizes fit.
3. Only qualifying groups are opened: q's whole set meets those of the members, and similarities are exact. A group of
   more than ``BLOCK`` members or queries is solved in blocks of members by blocks of queries, each a task's work.
4. An opened block gives, for each set in it, its links there (weighted by the partner's copies) and its tree; the
   trees make the classes.

Nothing is capped: the bound never loses a pair, whatever the order of tokens. Comparing distinct near copies is
quadratic in the size of their cluster, as exact numbers of links ask; everything before step 3 is linear in tokens, but
for queries times groups of one cluster, and the result is linear in documents.

Edge cases: null and empty texts, and texts of punctuation only, have no tokens and no links; rows with a null doc_id are
left out; rows that repeat a doc_id and its set count once; of a doc_id with several sets each is joined on its own, all
are one document of one class, and its links are those of all its sets (its own other sets included); an empty table gives
no rows; other columns are not looked at. Tokens are 48-bit hashes: two tokens of one pair of documents fall together
about once in 10**9 pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .shared import FLUSH, PACKED, Packer, buckets, exchanged, gathered, join48, packed_batch, place, repeated, runs, settled, split48, texts, tidy, unpacked
from .words import gram_at, grams, mix, slices, words

N, THRESHOLD = 3, 0.5
_SIZE = np.uint64(0x9E3779B97F4A7C15)
_LOW48 = np.uint64((1 << 48) - 1)
BLOCK = 8192  # members, and queries, of a group that one task compares
_SETS = "kind int, doc_id long, sig long, size int, grp long, n int, low binary, high binary"


def token_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: its first row, the (document, token) pairs, sorted and distinct, and the number of documents."""
    for part in slices(column):
        w = words(part, plain=True)
        at, token = grams(w, n)
        doc = w.doc()[at]
        count = np.diff(w.first)
        for k in range(1, n):
            short = np.flatnonzero(count == k)
            if len(short):
                doc = np.concatenate((doc, short))
                token = np.concatenate((token, gram_at(w.hash, w.first[short], k) * np.uint64(2 * k + 1)))
        key = (doc.astype(np.uint64) << np.uint64(48)) | (token & _LOW48)
        key.sort()
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        yield part.lo, (key >> np.uint64(48)).astype(np.int64), key & _LOW48, part.hi - part.lo


def _home(task: np.ndarray, name: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a set's name."""
    return place(mix((task.astype(np.uint64) << np.uint64(32)) | name), parts)


def _named(sig: list[int], names: dict[int, int], taken: set[int]) -> None:
    """Gives each new signature a name that no other set of the task has: its low 32 bits, or the next that are free."""
    for x in sig:
        name = x & 0xFFFFFFFF
        while name in taken:
            name = (name + 1) & 0xFFFFFFFF
        names[x] = name
        taken.add(name)


def _spread(n: int, parts: int):
    """Texts to token entries of distinct sets (kind 0, by token), documents (kind 1, by document) and set names (kind 2, by
    signature)."""

    def each(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tokens, owners, sets = Packer(parts, _TOKENS, zipped=True), Packer(parts, "i8 u8 u4", 1), Packer(parts, "u8 u4 u4 u4", 2)
        names: dict[int, int] = {}
        taken: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, doc, token, rows in token_sets(batch.column("text"), n):
                at = np.searchsorted(doc, np.arange(rows + 1))
                size = np.diff(at)
                some = np.flatnonzero(size)
                mixed = mix(token)
                sig = np.zeros(rows, np.uint64)
                if len(some):
                    sig[some] = mix(np.add.reduceat(mixed, at[some]) + size[some].astype(np.uint64) * _SIZE)
                own = ids[lo : lo + rows]
                yield from owners.add(place(own, parts), own, sig, size)
                _, first = np.unique(sig[some], return_index=True)
                new = np.array([k for k in some[first].tolist() if int(sig[k]) not in names], np.int64)
                _named(sig[new].tolist(), names, taken)
                name = np.zeros(rows, np.uint32)
                name[new] = [names[x] for x in sig[new].tolist()]
                fresh = np.zeros(rows, bool)
                fresh[new] = True
                mine = fresh[doc]
                of, (rest, bucket) = doc[mine], np.divmod(token[mine], np.uint64(parts))
                yield from tokens.add(bucket, name[of], np.full(len(of), task, np.uint32), *_planes(rest, 6))
                yield from sets.add(place(sig[new], parts), sig[new], np.full(len(new), task, np.uint32), name[new], size[new])
        for out in (tokens, owners, sets):
            yield from out.flush()

    return each


def _planes(x: np.ndarray, width: int) -> list[np.ndarray]:
    """The lower bytes of a column, each on its own: what numbers leave of their upper bytes is then shrunk away."""
    return list(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T[:width])


def _whole(planes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view("<u8").ravel()


_TOKENS = " ".join(["u4 u4", *["u1"] * 6])  # name, task; planes of the token without what its bucket, the remainder, says
_SHARED = " ".join(["u4 u4", *["u1"] * 12])  # name, bucket; planes of task, token's number in its bucket, names that have it


def _shared_only(parts: int):
    """Of a token bucket, the tokens that more than one name has, sent to their sets with that number."""

    def each(batches):
        from pyspark import TaskContext

        found = gathered(batches)
        here = TaskContext.get().partitionId()  # this bucket, in which documents are at home already
        if 1 in found:
            yield packed_batch([(here, 1, b.to_pybytes()) for b in found.pop(1)])
        sig, task, name, size = unpacked(found.pop(2, []), "u8 u4 u4 u4")
        if len(sig):
            order = np.lexsort((name, task, sig))
            sig, task, name, size = sig[order], task[order], name[order], size[order]
            at = runs(sig)
            least, times = at[:-1], np.diff(at)
            out = Packer(parts, "u4 u4 u8 u4 u4", 2)
            yield from out.add(_home(task[least], name[least], parts), task[least], name[least], sig[least], size[least], times)
            yield from out.flush()
        name, task, *planes = unpacked(found.pop(0, []), _TOKENS, zipped=True)
        if not len(task):
            return
        token, task, name = repeated(_whole(planes), task, name)
        del planes
        at = runs(token)
        often = np.diff(at)
        number = np.repeat(np.arange(len(often), dtype=np.uint32), often)
        order = np.lexsort((number, name, task))
        task, name, number, often = task[order], name[order], number[order], np.repeat(often, often)[order]
        out = Packer(parts, _SHARED, zipped=True)
        for lo in range(0, len(task), FLUSH):
            part = slice(lo, lo + FLUSH)
            planes = [p for x in (task[part], number[part], often[part]) for p in _planes(x, 4)]
            yield from out.add(_home(task[part], name[part], parts), name[part], np.full(len(name[part]), here, np.uint32), *planes)
        yield from out.flush()

    return each


def _reduced(threshold: float, parts: int):
    """The bucket's documents with their sets (kind 0; n is the number of rows with that doc_id), and each set's shared
    tokens, rarest first (kind 1), if it can have a partner."""

    def each(batches):
        found = gathered(batches)
        own, sig, size = unpacked(found.pop(1, []), "i8 u8 u4")
        if len(own):
            order = np.lexsort((sig, own))
            own, sig, size = own[order], sig[order], size[order]
            at = runs(own)
            times = np.repeat(np.diff(at), np.diff(at))
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (sig[1:] != sig[:-1])
            own, sig, size, times = own[new], sig[new], size[new], times[new]
            for lo in range(0, len(own), 50_000):
                part = slice(lo, lo + 50_000)
                m = len(own[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), pa.array(own[part]), pa.array(sig[part].view(np.int64)), pa.array(size[part].astype(np.int32)), pa.nulls(m, pa.int64()), pa.array(times[part].astype(np.int32)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], _FIELDS
                )
        task, name, known, size, times = unpacked(found.pop(2, []), "u4 u4 u8 u4 u4")
        key = (task.astype(np.uint64) << np.uint64(32)) | name
        order = np.argsort(key)
        key, known, size, times = key[order], known[order], size[order].astype(np.int64), times[order]
        name, bucket, *planes = unpacked(found.pop(0, []), _SHARED, zipped=True)
        if not len(name) or not len(key):
            return
        task, number, often = (_whole(planes[i : i + 4]) for i in (0, 4, 8))
        del planes
        entry = (task << np.uint64(32)) | name
        which = np.minimum(np.searchsorted(key, entry), len(key) - 1)
        keep = np.flatnonzero((key[which] == entry) & (often > times[which].astype(np.uint64)))  # the owner's, and not those of copies alone
        which, often = which[keep], often[keep]
        token = number[keep] * np.uint64(parts) + bucket[keep]
        if not len(which):
            return
        order = np.lexsort((token, often, which))
        which, token = which[order], token[order]
        sig = known[which]
        at = runs(which)
        which = which[at[:-1]]
        able = np.flatnonzero(np.diff(at) >= np.ceil(threshold * size[which] - 1e-9))
        rows = []
        for k in able.tolist():
            t = token[at[k] : at[k + 1]]
            low, high = split48(t)
            s = int(size[which[k]])
            least = np.uint64(mix(t).min()) >> np.uint64(8)
            grp = int((least << np.uint64(6)) | np.uint64(int(2 * math.log2(s)))) & ((1 << 63) - 1)
            rows.append((1, None, int(sig[at[k]].astype(np.int64)), s, grp, len(t), low.tobytes(), high.tobytes()))
            if len(rows) >= 2000:
                yield _set_batch(rows)
                rows = []
        if rows:
            yield _set_batch(rows)

    return each


_FIELDS = [x.split()[0] for x in _SETS.split(", ")]


def _set_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _FIELDS)


def prefix_extra(alpha: np.ndarray) -> np.ndarray:
    """l of the extended prefix, for a needed overlap of alpha."""
    return 1 + alpha // 16


def _matrix_entries(threshold: float, parts: int):
    """Prefix tokens of each set, with its group and size, to token buckets."""

    def each(batches):
        out = Packer(parts, "i8 u4 u2 i8 u4")
        for batch in batches:
            for doc, size, grp, n, low, high in zip(*(batch.column(c).to_pylist() for c in ("sig", "size", "grp", "n", "low", "high")), strict=True):
                alpha = math.ceil(threshold * size - 1e-9)
                take = size - alpha + int(prefix_extra(alpha)) - (size - n)
                if take > 0:
                    low, high = np.frombuffer(low, np.uint32)[:take], np.frombuffer(high, np.uint16)[:take]
                    m = len(low)
                    yield from out.add(place(mix(join48(low, high)), parts), np.full(m, doc), low, high, np.full(m, grp), np.full(m, size))
        yield from out.flush()

    return each


def _overlaps(threshold: float):
    """For each token of the bucket: its queries times its groups, counted by query and group."""

    def each(batches):
        doc, low, high, grp, size = unpacked(gathered(batches).get(0, []), "i8 u4 u2 i8 u4")
        if not len(doc):
            return
        token = join48(low, high)
        order = np.lexsort((doc, grp, token))
        token, doc, grp, size = token[order], doc[order], grp[order], size[order]
        own, doc_at = np.unique(doc, return_inverse=True)
        groups, grp_at = np.unique(grp, return_inverse=True)
        doc_size = np.zeros(len(own), np.int64)
        doc_size[doc_at] = size
        big, small = np.zeros(len(groups), np.int64), np.full(len(groups), 1 << 40)
        np.maximum.at(big, grp_at, size)
        np.minimum.at(small, grp_at, size)
        # Cells of the matrix: (token, group), with how many members have the token.
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])
        cell = np.flatnonzero(new)
        members = np.diff(np.append(cell, len(token)))
        cell_grp = grp_at[cell]
        at = runs(token)
        cells_before = np.searchsorted(cell, at)
        cells = np.diff(cells_before)  # groups of each token
        work = np.diff(at) * cells
        lo = 0
        total: tuple[list, list] = ([], [])
        ends = np.cumsum(work)
        while lo < len(work):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000, "right")))
            entry = np.arange(at[lo], at[hi])
            times = np.repeat(cells[lo:hi], np.diff(at[lo : hi + 1]))
            first = np.repeat(cells_before[lo:hi], np.diff(at[lo : hi + 1]))
            q = np.repeat(entry, times)
            c = np.repeat(first - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            g, d = cell_grp[c], doc_at[q]
            s = doc_size[d]
            fits = (members[c] > (g == grp_at[q])) & (big[g] >= threshold * s - 1e-9) & (small[g] * threshold <= s + 1e-9)
            pair, count = np.unique(d[fits] * len(groups) + g[fits], return_counts=True)
            total[0].append(pair)
            total[1].append(count)
            lo = hi
        pair, inverse = np.unique(np.concatenate(total[0]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate(total[1]), minlength=len(pair)).astype(np.int32) if len(pair) else np.zeros(0, np.int32)
        d = pair // max(1, len(groups))
        yield pa.RecordBatch.from_arrays([pa.array(own[d]), pa.array(groups[pair % max(1, len(groups))]), pa.array(count), pa.array(doc_size[d].astype(np.int32))], ["sig", "grp", "c", "size"])

    return each


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of the component of each of n vertices, by edges (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _opened(threshold: float, pairs: bool):
    """Rows sorted by block: members (role 0) and queries that open their group (role 1). Exact similarities; of two
    sets the one of the lesser signature asks. Gives the pairs (v, u, jaccard), or for each set that has any the least row
    of its tree and its number of links, weighted by copies (v, u, c)."""

    def solve(rows: list) -> pa.RecordBatch | None:
        _, g = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        role, sig, size, copies = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
        tokens = [join48(np.frombuffer(r[5], np.uint32), np.frombuffer(r[6], np.uint16)) for r in rows]
        members = np.flatnonzero(role == 0)
        queries = np.flatnonzero(role == 1)
        if not len(members) or not len(queries):
            return None
        key = np.concatenate([tokens[i] | (np.uint64(g[i]) << np.uint64(48)) for i in members])
        who = np.repeat(members, [len(tokens[i]) for i in members])
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        _, vertex, back = np.unique(sig, return_index=True, return_inverse=True)  # a set may be member and query
        links, label = np.zeros(len(vertex), np.int64), np.arange(len(vertex))
        out: tuple[list, list, list] = ([], [], [])
        lo = 0
        while lo < len(queries):
            hi, held = lo, 0
            qs: list = []
            while hi < len(queries) and held < 4_000_000:
                i = queries[hi]
                k = tokens[i] | (np.uint64(g[i]) << np.uint64(48))
                left, right = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
                qs.append((i, left, right - left))
                held += int((right - left).sum())
                hi += 1
            left, times = np.concatenate([x[1] for x in qs]), np.concatenate([x[2] for x in qs])
            q = np.repeat(np.repeat([x[0] for x in qs], [len(x[1]) for x in qs]), times)
            m = who[np.repeat(left - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
            fine = sig[q] < sig[m]
            pair, count = np.unique(q[fine] * len(rows) + m[fine], return_counts=True)
            q, m = pair // len(rows), pair % len(rows)
            j = count / np.maximum(size[q] + size[m] - count, 1)
            good = j >= threshold - 1e-12
            q, m = q[good], m[good]
            if pairs:
                for part, x in zip(out, (sig[q], sig[m], np.minimum(j[good], 1.0)), strict=True):
                    part.append(x)
            else:
                np.add.at(links, back[q], copies[m])
                np.add.at(links, back[m], copies[q])
                every = np.arange(len(vertex))
                label = _labels(len(vertex), np.concatenate((back[q], every)), np.concatenate((back[m], label)))
            lo = hi
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in out], ["v", "u", "jaccard"])
        some = np.flatnonzero(links)
        own = sig[vertex]
        return pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(own[label[some]]), pa.array(links[some])], ["v", "u", "c"])

    def each(batches):
        rows, held, groups = [], 0, 0
        for batch in batches:
            for grp, mb, qb, *rest in zip(*(batch.column(c).to_pylist() for c in ("grp", "mb", "qb", "role", "sig", "size", "k", "low", "high")), strict=True):
                row = ((grp, mb, qb), *rest)
                if rows and row[0] != rows[-1][0]:
                    groups += 1
                    if held > 1 << 20 or groups > 60_000:
                        done = solve(_numbered(rows))
                        if done is not None:
                            yield done
                        rows, held, groups = [], 0, 0
                rows.append(row)
                held += len(row[6]) // 2
        done = solve(_numbered(rows)) if rows else None
        if done is not None:
            yield done

    return each


def _numbered(rows: list) -> list:
    """Rows with their block's number in place of the block."""
    number: dict = {}
    return [(number.setdefault(r[0], len(number)), *r[1:]) for r in rows]


def _joined(docs: DataFrame, n: int, threshold: float, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, sig, size, n) of the documents; (sig, cid, k) of the classes of equal sets; what _opened gives."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold is in (0, 1] and n is positive")
    spark = docs.sparkSession
    parts = buckets(spark)
    spread = exchanged(texts(docs).mapInArrow(tidy(_spread(n, parts)), PACKED), parts)
    shared = exchanged(spread.mapInArrow(tidy(_shared_only(parts)), PACKED), parts)
    all_ = settled(shared.mapInArrow(tidy(_reduced(threshold, parts)), _SETS))
    owners = all_.where("kind = 0").select("doc_id", "sig", "size", "n")
    classes = settled(owners.where("size > 0").groupBy("sig").agg(F.min("doc_id").alias("cid"), F.count("*").alias("k")))
    sets = settled(all_.where("kind = 1").select("sig", "size", "grp", "n", "low", "high").join(classes.select("sig", "k"), "sig"))
    matrix = exchanged(sets.select("sig", "size", "grp", "n", "low", "high").mapInArrow(tidy(_matrix_entries(threshold, parts)), PACKED), parts)
    t = F.lit(float(threshold))
    needed = F.floor(F.ceil(t * F.ceil(t * F.col("size") - 1e-9) - 1e-9) / 16) + 1
    opened = matrix.mapInArrow(tidy(_overlaps(threshold)), "sig long, grp long, c int, size int").groupBy("sig", "grp").agg(F.sum("c").alias("c"), F.max("size").alias("size")).where(F.col("c") >= needed)
    opened = settled(opened.select("sig", "grp"))
    # Groups too large for a task, with the number of blocks on either side.
    large = sets.groupBy("grp").agg(F.count("*").alias("m")).join(opened.groupBy("grp").agg(F.count("*").alias("q")), "grp").where(f"m > {BLOCK} OR q > {BLOCK}")
    large = settled(large.select("grp", F.ceil(F.col("m") / BLOCK).alias("nm"), F.ceil(F.col("q") / BLOCK).alias("nq")))

    def blocked(side: DataFrame, role: int) -> DataFrame:
        mine, other = ("nm", "nq") if role == 0 else ("nq", "nm")
        block = F.pmod(F.xxhash64("sig"), F.coalesce(F.col(mine), F.lit(1))).cast("int").alias("own")
        side = side.join(large, "grp", "left").select("grp", "sig", "size", "k", "low", "high", block, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)).cast("int") - 1)).alias("other"))
        mb, qb = ("own", "other") if role == 0 else ("other", "own")
        return side.select("grp", F.col(mb).alias("mb"), F.col(qb).alias("qb"), F.lit(role).alias("role"), "sig", "size", "k", "low", "high")

    both = blocked(sets, 0).unionByName(blocked(sets.drop("grp").join(opened, "sig"), 1))
    both = both.repartition(parts, "grp", "mb", "qb").sortWithinPartitions("grp", "mb", "qb")
    return owners, classes, both.mapInArrow(tidy(_opened(threshold, pairs)), "v long, u long, jaccard double" if pairs else "v long, u long, c long")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_a, doc_b, jaccard), doc_a < doc_b, between the least documents of different sets; each further document
    of a set is a pair with its least one."""
    owners, classes, near = _joined(docs, n, threshold, True)
    a, b = (classes.select(F.col("sig").alias(v), F.col("cid").alias(c)) for v, c in (("v", "a"), ("u", "b")))
    between = near.join(a, "v").join(b, "u").where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")
    copies = owners.where("size > 0").join(classes.where("k > 1"), "sig").where("doc_id <> cid").select(F.col("cid").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return copies.unionByName(between)


def _linked(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id, n_links) of linked documents, and the documents' table of _joined."""
    owners, classes, near = _joined(docs, n, threshold, False)
    near = settled(near)
    several = owners.where("n > 1 AND size > 0").select("doc_id", F.col("sig").alias("v"))
    edges = near.select("v", "u").where("v <> u").unionByName(several.join(several.groupBy("doc_id").agg(F.min("v").alias("u")), "doc_id").where("v <> u").select("v", "u"))
    found = components(edges, "v", "u").select(F.col("doc_id").alias("sig"), F.col("group_id").alias("root"))
    least = classes.join(found, "sig").groupBy("root").agg(F.min("cid").alias("class_id"))
    links = near.groupBy(F.col("v").alias("sig")).agg(F.sum("c").alias("c"))
    of_set = classes.join(links, "sig", "left").join(found.join(least, "root").select("sig", "class_id"), "sig", "left")
    of_set = settled(of_set.select("sig", "k", F.coalesce("class_id", "cid").alias("class_id"), (F.col("k") - 1 + F.coalesce("c", F.lit(0))).alias("n_links")).where("n_links > 0"))
    # Sets of very many copies meet their documents by broadcast: fewer than 100,000 sets can have over a 100,000th of all.
    total = owners.count()
    limit = max(10_000, total // 100_000)
    hot = F.broadcast(of_set.where(F.col("k") > limit).select("sig", "class_id", "n_links"))
    own = owners.where("size > 0").select("doc_id", "sig")
    rows = own.join(hot, "sig").unionByName(own.join(F.broadcast(of_set.where(F.col("k") > limit).select("sig")), "sig", "left_anti").join(of_set.where(F.col("k") <= limit).select("sig", "class_id", "n_links"), "sig"))
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links")), owners


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): a row for every document that has a link."""
    return _linked(docs, n, threshold)[0]


def _forest(batches):
    """The edges of a partition, as a spanning forest of its vertices: (vertex, least vertex of its tree)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    edges = [(x, root(x)) for x in up]
    edges = [e for e in edges if e[0] != e[1]]
    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["v", "u"])


def components(pairs: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(doc_id, group_id): every vertex of ``pairs`` with the least vertex of its connected component.

    Each partition first shrinks to a spanning forest; then large-star and small-star steps (Kiveris et al., 2014) run
    on tables written in the shared folder until nothing changes. Raises if that takes more than ``rounds`` rounds.
    """
    edges = settled(pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).mapInArrow(tidy(_forest), "v long, u long").distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        down = large.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u"))
        low = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(low.select("v", F.col("m").alias("u")))
        edges = settled(small.distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point")
    return edges.select(F.col("v").alias("doc_id"), F.col("u").alias("group_id")).unionByName(edges.select(F.col("u").alias("doc_id"), F.col("u").alias("group_id")).distinct())


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs, in their own columns, without all but the least doc_id of each class of linked documents. A document without
    links stays, as do rows with a null doc_id; of rows that repeat a doc_id the least stays, by text and then by the
    other columns in their order (columns that have no order don't count)."""
    linked, owners = _linked(docs, n, threshold)
    gone = linked.where("doc_id <> class_id").select(F.col("doc_id").alias("__quill_id"))
    again = owners.where("n > 1").select(F.col("doc_id").alias("__quill_id")).distinct()
    out = settled(gone.unionByName(again).distinct())
    alone = docs.join(out, docs["doc_id"].cast("long") == out["__quill_id"], "left_anti")
    again = settled(again.join(gone, "__quill_id", "left_anti"))
    if again.isEmpty():
        return alone
    rows = docs.join(again, docs["doc_id"].cast("long") == again["__quill_id"])
    ordered = [c for c in docs.columns if c != "text" and not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    rest = F.struct(*[docs[c] for c in docs.columns])
    one = rows.groupBy("__quill_id").agg(F.min_by(rest, F.struct(docs["text"], *[docs[c] for c in ordered])).alias("__quill_row"))
    return alone.unionByName(one.select("__quill_row.*"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))
                     ELSE [array_to_string(ws, ' ')] END AS g FROM w WHERE len(ws) > 0),
d AS MATERIALIZED (SELECT doc_id, md5(array_to_string(g, '|')) AS cls, g FROM s),
k AS MATERIALIZED (SELECT cls, any_value(g) AS g, any_value(len(g)) AS n, min(doc_id) AS lead, count(*) AS k FROM d GROUP BY cls),
t AS MATERIALIZED (SELECT cls, n, k, unnest(g) AS token FROM k),
p AS MATERIALIZED (SELECT a.cls AS a, b.cls AS b, any_value(b.k) AS kb FROM t a JOIN t b ON a.token = b.token AND a.cls <> b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5),
l AS (SELECT k.cls, k.k - 1 + coalesce(sum(p.kb), 0) AS links FROM k LEFT JOIN p ON k.cls = p.a GROUP BY k.cls, k.k),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT x.cls, y.cls FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.cls <> y.cls),
r AS (SELECT cls, lead AS lab FROM k UNION SELECT e.b, r.lab FROM r JOIN e ON e.a = r.cls JOIN k ON k.cls = e.b WHERE r.lab < k.lead),
c AS (SELECT cls, min(lab) AS class_id FROM r GROUP BY cls)
SELECT doc_id, min(class_id) AS class_id, CAST(sum(links) AS BIGINT) AS n_links FROM d JOIN c USING (cls) JOIN l USING (cls) GROUP BY doc_id HAVING sum(links) > 0
"""
