"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

Every link (Jaccard similarity of the shingle sets at or above the threshold) between different sets
takes effect; documents of equal sets form one class first. The steps:

1. A document becomes the sorted array of its shingles' 64-bit hashes. Under one order of all hashes
   (frequent ones last) two similar sets share one of their first ``n - ceil(t * n) + 1`` hashes,
   the prefix. A tile is all classes with a common prefix hash, ordered by set size and divided into
   bands within which sizes allow a link.
2. Each member of a band is compared with the band's first. These comparisons connect groups of near
   copies without forming their pairs.
3. Tiles that hold members of more than one component are searched: pairs of different components
   in the same or neighbouring size bands pass if bit counts of their hashed bitmaps leave enough
   overlap possible. Large bands are cut into chunks whose pairs are separate work. Each member's
   closest pairs come first; rounds with ever more of them follow, with the components as they are
   by then, until no member has a pair left.
4. Every candidate is verified by intersecting the sorted arrays; components follow from the links.

Links within a component that other links connect already are not listed. Frequent hashes are found
on a bounded sample; they only change the order, never the result.

Edge cases: null or empty texts have no shingle and link with nothing; with fewer words than a
shingle has, the whole sequence is the one shingle; equal texts share a component; rows that share a
doc_id are documents of their own, of one class if their sets are equal; a component of rows without
a doc_id has none; an empty table gives an empty result; further columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, WordHash, discard, give_back, materialize, quoted, release, slices, small
from tidemark.llm.components import components

WORDS = 5
#: Documents sampled to find frequent shingles, how often these occur there, and how many are kept at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 8_000, 3, 200_000
#: Occurrences in the sample from which a hash's tile is dealt to SALTS parts.
HOT, SALTS = 16, 32
#: Closest pairs that each member of a tile gives in the first round; GROWTH times as many in each further one.
CLOSEST, GROWTH = 2, 32
#: Rows of a size band that are searched as one piece of work, and how many are compared at once.
CHUNK, BLOCK = 512, 512

# Odd numbers with well mixed bits, added to the hash of a shingle's first, second, ... word.
_factors = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64,
)
_places = _factors * np.arange(1, len(_factors) + 1, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingles(text: bytes | None, hashes: WordHash, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles; A-Z count as a-z."""
    h = np.frombuffer(b"".join(map(hashes.__getitem__, (text or b"").lower().split())), dtype="<u8")
    if not len(h):
        return h
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, _mix(_places[size - 1 : size])[0], dtype=np.uint64)
    for i in range(size):
        total += _mix(h[i : len(h) - size + 1 + i] + _places[(i + 1) % len(_places)])
        total = _mix(total)
    return _distinct(total)


class Order(NamedTuple):
    """Hashes that come last: ``hashes`` ascending, and which of them are hot."""

    hashes: np.ndarray
    hot: np.ndarray


def prefix(sorted_hashes: np.ndarray, order: Order, num: int, den: int) -> tuple[np.ndarray, int]:
    """The hashes of which two similar sets share one, and how many of these are not hot.

    The order of all hashes: those not frequent, the frequent, the hot; each ascending.
    """
    n = len(sorted_hashes)
    length = n - -(-num * n // den) + 1 if n else 0
    if not len(order.hashes):
        return sorted_hashes[:length], length
    at = np.minimum(np.searchsorted(order.hashes, sorted_hashes), len(order.hashes) - 1)
    late = order.hashes[at] == sorted_hashes
    hot = late & order.hot[at]
    chosen = np.concatenate([sorted_hashes[~late], sorted_hashes[late & ~hot], sorted_hashes[hot]])[:length]
    return chosen, min(length, int(n - hot.sum()))


def bitmap(sorted_hashes: np.ndarray) -> bytes:
    """The parity of the hashes that fall on each bit; at least four bits for five hashes."""
    bits = 64
    while 5 * bits < 4 * len(sorted_hashes):
        bits *= 2
    parity = np.bincount((sorted_hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def sketch(sorted_hashes: np.ndarray) -> bytes:
    """The set size in eight bytes, then the bitmap."""
    return len(sorted_hashes).to_bytes(8, "little") + bitmap(sorted_hashes)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) brought to fewer words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted arrays reach the threshold."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _numbered(docs: DataFrame) -> DataFrame:
    """Each row with a number, its doc_id, a fingerprint of doc_id and text, and the text's bytes."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col("text")).alias("print"), F.col("text").cast("binary").alias("text"))


def _order(rows: DataFrame, words: int) -> Order:
    """The hashes that occur in many documents of a bounded sample of ``rows``."""
    n = rows.count()
    if n > SAMPLE:
        rows = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < int(SAMPLE / n * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, hashes, words) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])
        give_back()

    counted = rows.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= FREQUENT)
    found = counted.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).toArrow()
    values, often = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy() >= HOT
    ascending = np.argsort(values)
    return Order(values[ascending], often[ascending])


def signatures(docs: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """row, doc_id, print, n (set size), key (128 bits of the set), prefix hashes, how many of them are not hot, sketch."""
    rows = _numbered(docs)
    sent = docs.sparkSession.sparkContext.broadcast(_order(rows, words))  # MOST_FREQUENT hashes at most
    kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("prefix", pa.list_(pa.int64())), ("light", pa.int32()), ("sketch", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order = WordHash(), sent.value
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, hashes, words) for t in part.column(3).to_pylist()]
                chosen = [prefix(s, order, num, den) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(c) for c, _ in chosen])]).astype(np.int32)
                values = np.concatenate([c for c, _ in chosen]).view(np.int64)
                sizes, light = pa.array([len(s) for s in sets], pa.int64()), pa.array([k for _, k in chosen], pa.int32())
                keys, sketches = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sizes, keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), light, sketches], schema=schema)
        give_back()

    return rows.mapInArrow(run, "row long, doc_id long, print long, n long, key binary, prefix array<long>, light int, sketch binary")


def tiles(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(token, node, n, pos, leader) of tiles with two members or more, from rows (token, aux, node).

    aux is salt * 2^58 + n * 2^29 + pos, the salt 0 unless the token is hot; pos is the token's place in
    the prefix. A member's leader is the first of its size band; a band's first has the first of the
    band before. Rows of hot tokens stay even if alone in their part of the tile. Memory does not depend
    on a tile's size.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("token", "node", "n", "pos", "leader")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (token, salt, leader, its n, whether it was given out, its pos)
        for batch in batches:
            if not batch.num_rows:
                continue
            token, aux, rep = (c.to_numpy() for c in batch.columns)
            salt, n, pos = aux >> 58, (aux >> 29) & (1 << 29) - 1, aux & (1 << 29) - 1
            if last and not last[4]:  # the row that waits for company comes first again
                token, salt, n, rep, pos = (np.concatenate([[last[i]], y]) for i, y in zip((0, 1, 3, 2, 5), (token, salt, n, rep, pos), strict=True))
                last = None
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            if last and (token[0], salt[0]) == last[:2]:
                new[0] = False
            starts = np.flatnonzero(new)
            run_no = np.cumsum(new) - 1
            first = np.where(run_no >= 0, starts[np.maximum(run_no, 0)] if len(starts) else 0, 0)
            leader, leader_n = rep[first].copy(), n[first].copy()
            open_ = run_no < 0
            if open_.any():
                leader[open_], leader_n[open_] = last[2], last[3]
            wide = np.flatnonzero(den * leader_n < num * n)
            for r in np.unique(run_no[wide]):  # runs whose sizes need several bands
                rows = np.flatnonzero(run_no == r) if r < 0 else np.arange(starts[r], starts[r + 1] if r + 1 < len(starts) else len(token))
                now, now_n = leader[rows[0]], leader_n[rows[0]]
                for i in rows:
                    leader[i], leader_n[i] = now, now_n
                    if den * now_n < num * n[i]:
                        now, now_n = rep[i], n[i]
                if rows[-1] == len(token) - 1:
                    end = (now, now_n)
            alone = new & np.concatenate([new[1:], [True]])
            waits = bool(alone[-1])
            give = ~alone | (salt > 0)
            if waits:
                give[-1] = False
                last = (token[-1], salt[-1], rep[-1], n[-1], False, pos[-1])
            else:
                now = end if len(wide) and run_no[wide[-1]] == run_no[-1] else (leader[-1], leader_n[-1])
                last = (token[-1], salt[-1], now[0], now[1], True, 0)
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[give]) for x in (token, rep, n, pos, leader)], schema=schema)
        if last and not last[4] and last[1] > 0:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (last[0], last[2], last[3], last[5], last[2])], schema=schema)
        give_back()

    dealt = entries.repartition("token", F.shiftright("aux", 58)).sortWithinPartitions("token", "aux", "node")
    return dealt.mapInArrow(run, "token long, node long, n long, pos long, leader long")


def _arrays(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, value: the sorted array) of the classes in ``wanted`` (node, key, print), a staged table.

    Only rows with a wanted fingerprint leave the JVM.
    """
    schema = pa.schema([("key", pa.binary()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, hashes, words).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], schema=schema)
        give_back()

    rows = _numbered(docs).join(small(wanted.select("print")), "print", "left_semi").select("text")
    held = rows.mapInArrow(run, "key binary, value binary").groupBy("key").agg(F.first("value").alias("value"))  # a row may stand several times
    return materialize(held.join(small(wanted.select("node", "key")), "key").select("node", "value"), "arrays")


def _checked(pairs: DataFrame, sides: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) for which ``test`` holds on the values that ``sides`` (node, value) gives them.

    The values of b travel to those of a, as many pairs share their a.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            kept = pa.array([test(x[i].as_buffer(), y[i].as_buffer()) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], schema=schema)
        give_back()

    of = lambda side: sides.select(F.col("node").alias(side), F.col("value").alias(f"v{side}"))
    return pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: bit counts first, then the sorted arrays of those left."""

    def may(x: pa.Buffer, y: pa.Buffer) -> bool:
        (n, u), (m, v) = (((int.from_bytes(z[:8], "little"), np.frombuffer(z, dtype="<u8", offset=8))) for z in (x, y))
        if den * min(n, m) < num * max(n, m):
            return False
        least = min(len(u), len(v))
        return bool(_possible(n, m, int(np.bitwise_count(folded(u, least) ^ folded(v, least)).sum()), num, den))

    left = materialize(_checked(pairs, nodes.select("node", F.col("sketch").alias("value")), may), "possible")
    ids = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(nodes.select("node", "key", "print").join(ids, "node", "left_semi"), "wanted")
    arrays = _arrays(docs, wanted, words)
    links = materialize(_checked(left, arrays, lambda x, y: similar(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), num, den)), "links")
    discard(left, wanted, arrays)
    return links


def _possible(n: int | np.ndarray, m: int | np.ndarray, apart: int | np.ndarray, num: int, den: int) -> bool | np.ndarray:
    """Whether sets of n and m hashes can reach the threshold if their bitmaps differ in ``apart`` bits.

    Each differing bit needs a hash that one set has alone, so the overlap is (n + m - apart) / 2 at most;
    den * overlap >= num * (n + m - overlap) then gives the test.
    """
    return (den + num) * (n + m - apart) >= 2 * num * (n + m)


def _best(rows: np.ndarray, other: np.ndarray, close: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The ``k`` closest partners of each row, and whether some row had more."""
    order = np.lexsort((other, -close, rows))
    rows, other, close = rows[order], other[order], close[order]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < k
    return rows[kept], other[kept], close[kept], not kept.all()


def _search(home: np.ndarray, others: np.ndarray, rows: list[tuple], k: int, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(a, b, whether some had more): each home row's ``k`` closest among the others that sizes, positions and bits allow.

    ``rows`` has (node, n, root, pos, sketch); ``home`` and ``others`` are positions in it.
    """
    width = min(len(r[4]) // 8 - 1 for r in rows)
    nodes, sizes, roots, places = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(4))
    rest = sizes - places
    bits = np.stack([folded(np.frombuffer(r[4], dtype="<u8", offset=8), width) for r in rows])
    for i in range(0, len(home), BLOCK):
        mine = home[i : i + BLOCK]
        held = (np.array([], np.int64), np.array([], np.int64), np.array([]))
        more = False
        for j in range(0, len(others), BLOCK):
            theirs = others[j : j + BLOCK]
            n, m = sizes[mine][:, None], sizes[theirs][None, :]
            ok = (roots[mine][:, None] != roots[theirs][None, :]) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
            ok &= (den + num) * np.minimum(rest[mine][:, None], rest[theirs][None, :]) >= num * (n + m)
            p, q = np.nonzero(ok)
            for s in range(0, len(p), 1 << 16):
                x, y = mine[p[s : s + (1 << 16)]], theirs[q[s : s + (1 << 16)]]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                good = _possible(sizes[x], sizes[y], apart, num, den)
                both = (sizes[x] + sizes[y])[good]
                found = x[good], y[good], (both - apart[good]) / (both + apart[good])
                held = tuple(np.concatenate(c) for c in zip(held, found, strict=True))
                *held, now = _best(*held, k)
                more |= now
        if len(held[0]):
            a, b = nodes[held[0]], nodes[held[1]]
            yield np.minimum(a, b), np.maximum(a, b), more


#: What a row is to a piece of work: searched for partners, or a partner only.
_HOME, _PARTNER = 0, 1


def _pieces(members: DataFrame, num: int, den: int) -> DataFrame:
    """``members`` dealt to pieces of work (token, band, i, m): chunk i of a band against chunk m of it and of the next one.

    The limits of size bands grow by den / num. A band of more than CHUNK rows is cut by a hash of the
    node, so a row goes to as many pieces as its band and the two beside it have chunks. Pieces in which
    a chunk meets an earlier one of its own band are left out.
    """
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9))
    sizes = banded.groupBy("token", "band").agg(F.count("*").alias("c")).filter(F.col("c") > CHUNK)
    large = materialize(sizes.select("token", "band", F.ceil(F.col("c") / CHUNK).alias("chunks")), "large")
    rows, cut = banded, large.count()
    for column, step in (("own", 0), ("next", 1), ("before", -1)):
        at = large.select("token", (F.col("band") - step).alias("band"), F.col("chunks").alias(column))
        rows = rows.join(F.broadcast(at) if cut <= BROADCAST_ROWS else at, ["token", "band"], "left").withColumn(column, F.coalesce(column, F.lit(1).cast("long")))
    chunk = F.pmod(F.xxhash64("node"), F.col("own"))
    piece = lambda band, i, m, role: F.struct(band.alias("band"), i.cast("long").alias("i"), m.cast("long").alias("m"), F.lit(role).alias("role"))
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long"))), lambda x: x < n)
    home = F.transform(upto(F.greatest("own", "next")), lambda m: piece(F.col("band"), chunk, m, _HOME))
    same = F.transform(upto(chunk), lambda i: piece(F.col("band"), i, chunk, _PARTNER))
    above = F.transform(upto(F.col("before")), lambda i: piece(F.col("band") - 1, i, chunk, _PARTNER))
    return rows.select("token", F.explode(F.concat(home, same, above)).alias("x"), "node", "n", "root", "pos", "sketch").select("token", "x.*", "node", "n", "root", "pos", "sketch")


def _pairs_of_tiles(members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components in a tile that sizes and bit counts allow.

    ``members`` has (token, node, n, root, pos, sketch). At the first hash that two prefixes share, what
    follows it bounds the overlap; other tiles of a pair fail that bound sooner or later and need not
    repeat it. Each row gives its ``k`` closest pairs of a piece; a further row (null, null, token) tells
    that some had more.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch):
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, _, i, m), piece in groupby(rows(batches), key=lambda r: r[:4]):
            held = list(piece)
            if len({r[7] for r in held}) < 2:
                continue
            role = np.array([r[4] for r in held])
            home = np.flatnonzero(role == _HOME)
            partners = np.arange(len(held)) if i == m else np.flatnonzero(role == _PARTNER)
            cut = False
            for a, b, more in _search(home, partners, [r[5:] for r in held], k, num, den):
                cut |= more
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, token)], schema=schema)
        give_back()

    names = ["token", "band", "i", "m", "role", "node", "n", "root", "pos", "sketch"]
    dealt = _pieces(members, num, den).select(names).repartition(*names[:4]).sortWithinPartitions(*names[:6])
    return dealt.mapInArrow(run, "a long, b long, token long").distinct()


class Linked(NamedTuple):
    """What ``_link`` finds: a signature for each row, the classes, each linked class's root, the links."""

    rows: DataFrame  # row, doc_id, print, n, key, ...
    nodes: DataFrame  # node, rep, n, key, print, sketch
    roots: DataFrame  # node, root: structs (id, node), ordered by doc_id
    links: DataFrame  # a, b: nodes


def _named(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between structs (no id, id, node), so that the smallest node of a component has its smallest doc_id."""
    name = lambda side: nodes.select(F.col("node").alias(side), F.struct(F.col("rep").isNull().alias("nameless"), F.col("rep").alias("id"), "node").alias(f"{side}_named"))
    both = links.join(name("a"), "a").join(name("b"), "b")
    return both.select(F.col("a_named").alias("a"), F.col("b_named").alias("b"))


def _link(docs: DataFrame, num: int, den: int, words: int) -> Linked:
    spark = docs.sparkSession
    sigs = materialize(signatures(docs, num, den, words), "signatures")
    # a class is named by its smallest row number
    first = F.min(F.struct("row", "n", "print", "sketch")).alias("x")
    grouped = sigs.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), first)
    nodes = materialize(grouped.select(F.col("x.row").alias("node"), "rep", "x.n", "key", "x.print", "x.sketch"), "nodes")
    salt = F.when(F.col("pos") >= F.col("light"), F.pmod(F.xxhash64("row"), F.lit(SALTS - 1)) + 1).otherwise(F.lit(0).cast("long"))
    hashes = sigs.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select("row", "n", "light", F.posexplode("prefix").alias("pos", "token"))
    tile = materialize(tiles(hashes.select("token", (salt * (1 << 58) + F.col("n") * (1 << 29) + F.col("pos")).alias("aux"), F.col("row").alias("node")), num, den), "tiles")
    del hashes
    release(spark)

    # the parts of a hot token's tile are joined through their leaders, here by the smallest of a token
    leaders = tile.filter("leader = node").groupBy("token", "leader").agg(F.lit(1))
    across = leaders.join(leaders.groupBy("token").agg(F.min("leader").alias("first")), "token").filter("first <> leader")
    of_tiles = tile.filter("leader <> node").select("token", F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    of_tiles = of_tiles.union(across.select("token", F.least("first", "leader"), F.greatest("first", "leader")))
    tried = materialize(of_tiles.select("a", "b").distinct(), "tried")
    links = _verified(docs, nodes, tried, num, den, words)
    roots = components(_named(links, nodes))
    root = lambda name, to: roots.select(F.col("node.node").alias(name), F.col("root.node").alias(to))

    # tiles in which some member and its leader, or two leaders, are still apart; two members have been
    # compared already, and of tiles with the same members the first in the order of hashes is enough
    apart = tried.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    unlinked = of_tiles.join(materialize(apart, "apart"), ["a", "b"], "left_semi").select("token").distinct()
    alike = tile.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min_by("pos", "node").alias("p"))
    alike = alike.filter("c > 2").join(unlinked, "token", "left_semi").groupBy("c", "x", "y").agg(F.min_by("token", "p").alias("token"))
    tokens = materialize(alike.select("token", "c"), "tokens")
    members = materialize(tile.join(small(tokens), "token").select("token", "node", "n", "pos", "c"), "members")
    discard(tile)

    # first each member's largest tile alone, then all tiles, then those with pairs left
    largest = members.groupBy("node").agg(F.max_by("token", F.struct("c", "token")).alias("token"))
    rows, k, first_round = members.join(largest, ["node", "token"], "left_semi").withColumn("pos", F.lit(0).cast("long")), CLOSEST, True
    while True:
        placed = materialize(rows.join(root("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        still = materialize(placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token"), "still")
        searched = placed.join(small(still), "token", "left_semi").join(nodes.select("node", "sketch"), "node")
        found = materialize(_pairs_of_tiles(searched, k, num, den), "found")
        new = materialize(found.filter("a is not null").select("a", "b").join(tried, ["a", "b"], "left_anti"), "candidates")
        if not new.isEmpty():
            more = _verified(docs, nodes, new, num, den, words)
            before, tried = tried, materialize(tried.union(new), "tried")
            discard(before)
            if not more.isEmpty():
                before, old, links = links, roots, materialize(links.union(more), "links")
                roots = components(_named(links, nodes))
                discard(before, old)
            discard(more)
        left = materialize(found.filter("token is not null").select("token").distinct(), "left")
        discard(placed, still, found, new)
        if first_round:
            rows, first_round = members, False
        elif left.isEmpty():
            break
        else:
            rows, k = members.join(small(left), "token", "left_semi"), k * GROWTH
    discard(members, tried, tokens)
    return Linked(sigs, nodes, roots, links)


def link(docs: DataFrame, *, num: int = 75, den: int = 100, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(membership, links): doc_id, n_shingles, class_id and component_id of each row; linked classes (a, b).

    A class is all documents of one set, named by its smallest doc_id. The links connect each
    component; they need not hold links between classes that other links connect.
    """
    found = _link(docs, num, den, words)
    names = found.nodes.select("node", "key", "rep").join(found.roots.select(F.col("node.node").alias("node"), F.col("root.id").alias("smallest")), "node", "left")
    members = found.rows.select("doc_id", "n", "key").join(names, "key", "left")
    members = members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("smallest", "rep", "doc_id").alias("component_id"))
    name = lambda side: found.nodes.select(F.col("node").alias(side), F.col("rep").alias(f"{side}_id"))
    return members, found.links.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def one_of_each(docs: DataFrame, *, num: int = 75, den: int = 100, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all their columns, but of each component only the one with the smallest doc_id.

    Rows without shingles stay. Of rows that tie on doc_id and text, the least in the order of the
    other columns stays (any of them if a column has no order).
    """
    found = _link(docs, num, den, words)
    names = found.nodes.select("node", "key").join(found.roots.select(F.col("node.node").alias("node"), F.col("root.node").alias("root")), "node", "left")
    filled = found.rows.filter("n > 0").select("doc_id", "print", "key")
    placed = filled.join(names, "key").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print")
    best = placed.groupBy("root").agg(F.min(order).alias("x")).select("x.print")
    copies = filled.groupBy("print").agg(F.count("*").alias("rows"))
    best = materialize(best.join(copies, "print"), "best")
    empty = found.rows.filter("n = 0").select("print").distinct()
    taken = {c.lower() for c in docs.columns}
    mark = next(c for i in range(len(taken) + 1) if (c := f"print_{i}") not in taken)
    marked = docs.withColumn(mark, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    semi = lambda side: marked.join(side.select(F.col("print").alias(mark)), mark, "left_semi")
    single = semi(best.filter("rows = 1").select("print").union(empty)).select(*map(quoted, docs.columns))
    several = semi(best.filter("rows > 1"))
    ordered = all(not any(t in kind for t in ("map<", "variant", "interval")) for _, kind in docs.dtypes)
    pick = F.min if ordered else F.first
    whole = F.struct(*(F.col(quoted(c)) for c in docs.columns))
    return single.union(several.groupBy(mark).agg(pick(whole).alias("whole")).select("whole.*"))


def sql(num: int = 75, den: int = 100, words: int = WORDS) -> str:
    """The rows of ``link`` without its classes as SQL for DuckDB, over all pairs that share a shingle."""
    spaces = " || ".join(f"chr({c})" for c in (32, *range(9, 14)))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = f"translate(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), {spaces}, '{' ' * 6}')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split({text}, ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END) AS x FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n u ON u.r = a JOIN n v ON v.r = b WHERE {den} * c >= {num} * (u.n + v.n - c)),
reached AS (SELECT r, r AS other FROM d UNION SELECT reached.r, l.b FROM reached JOIN l ON l.a = reached.other),
smallest AS (SELECT reached.r, min(o.doc_id) AS component_id FROM reached JOIN d o ON o.r = reached.other GROUP BY reached.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN smallest USING (r) LEFT JOIN n USING (r)"""
