"""Exact n-gram Jaccard join and its components, with signature trees.

A document's set is its distinct word n-grams, as 64-bit hashes in ascending order. Two
documents link when 100 * intersection >= percent * union. Links are found exactly:

1. Equal sets collapse to one class, whose node is its smallest document.
2. Sets that link share at least l rows of an index. From ``PARTS_FROM`` percent on, the rows
   are hashes of parts: sets that link differ in at most k hashes, so if hashes deal both into
   k + l parts, l of the parts are equal. k and l come from a class of sizes, and a set has rows
   in each class that the larger set of a link could have. Parts of several n-grams are hardly
   ever equal by chance, however many documents there are. At lower percents, parts would be
   small and many; there the rows are the first (size - least overlap + l) hashes, and l is one
   more than the hashes that a linked set may lack. A document too few of whose rows occur
   anywhere else links with nothing and leaves; in most corpora that is nearly every document.
   The texts of the rest are put into buckets once, and a verification moves only one of the two
   texts of a pair.
3. Stars: every remaining node is verified against the smallest node that shares most of
   its rows, and then, under another order of nodes, again. Groups of near copies, however
   large, become components here at one or two verifications a node.
4. Rows shared by different components are searched for the links that stars missed. A node
   is searched under its rarest rows only: where sets that link share l rows, its l - 1 most
   common ones are left out, and the rarest that two such sets share is never among them.
   Each row's nodes, in blocks of bounded size, form signature trees: leaves and inner
   nodes hold OR-combined token bitmaps, least bitmap weights, and size ranges. Two trees
   are traversed together; a pair of tree nodes is left when no document below one could
   overlap enough with one below the other, or when all belong to one component already.
   Surviving pairs are verified on the sets. Every node brings its ``CARRIED`` rarest rows
   along; a pair that shares some of these leaves the search under the smallest of them only.

Nothing is capped: rows that very many nodes share are searched like the rest, in blocks.

Defined results: null, empty and blank texts have empty sets and link with nothing; fewer
words than n make one n-gram of all of them; very long texts take part whole, with bitmaps of a
sample of their hashes; a null id counts as the smallest and is shown as null; rows that repeat
an id are separate documents; of a component's documents the smallest id names it, and where
texts share that id the hash of the text decides which of them ``one_of_each`` keeps; an empty
table gives an empty table. Extra columns are ignored by ``join`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, id_or_least, release, scratch, shown_id, text_or_empty, written, written_in_buckets
from .components import components

WORDS, PERCENT = 3, 90
BITS = 4096
LEAF = 32
#: Sizes up to which a bitmap holds every token; above, it holds a half, a quarter ... of them.
FULL = 2048
#: From so many percent on, index rows are parts of sets. With 3-word n-grams at 90 they leave fewer documents and rows than single hashes do, with 5-word ones at 80 more.
PARTS_FROM = 90
#: Least sizes of the classes of sizes, each about half as large again as the one before.
CLASSES = [1, 2, 3]
while CLASSES[-1] < 2**40:
    CLASSES.append(CLASSES[-1] * 3 // 2)
#: Nodes of one row that are searched together.
BLOCK = 2048
#: Rows that a node brings along to each of its rows, so that most pairs are found once.
CARRIED = 16
#: Ids up to which a table of them is broadcast.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, words: int) -> list[bytes]:
    """The text's word n-grams in order, repeats included; one of all words if there are fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return [b" ".join(g) for g in zip(*(w[i:] for i in range(words)), strict=False)]


def token_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the word n-grams."""
    from xxhash import xxh3_64_intdigest

    return np.unique(np.array([*map(xxh3_64_intdigest, shingles(text, words))], np.uint64)).view(np.int64)


def links(x: str | None, y: str | None, words: int, percent: int) -> bool:
    a, b = set(shingles(x, words)), set(shingles(y, words))
    common = len(a & b)
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def index_rows(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """48 bits of each index row of a set, and the least number of rows that it shares with any other set that links."""
    n = len(tokens)
    if percent < PARTS_FROM:
        overlap = -(-n * percent // 100)
        return tokens[: 2 * (n - overlap) + 1].view(np.uint64) >> np.uint64(16), overlap + -overlap * percent // 100 + 1
    mine, rows, least = tokens.view(np.uint64), [np.zeros(0, np.uint64)], []
    for c in range(bisect_right(CLASSES, n) - 1, bisect_right(CLASSES, 100 * n // percent)) if n else ():
        differ = 2 * (CLASSES[c + 1] - 1) * (100 - percent) // (100 + percent)
        least.append(1 + differ // 8)
        if differ:  # else only equal sets link, which are one class
            parts = differ + least[-1]
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, (mine >> np.uint64(32)) % np.uint64(parts), _mixed(mine))
            rows.append(_mixed(sums + _mixed(np.arange(parts, dtype=np.uint64) + np.uint64(c << 40))) >> np.uint64(16))
    return np.concatenate(rows), min(least, default=1)


def documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Written: doc_id, text_hash (Spark's), d (hash of the text), n, d1, d2 (128 bits of hash of the set), least and rows as ``index_rows`` has them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column("text").to_pylist():
                tokens = token_set(text, words)
                raw, (rows, least) = tokens.tobytes(), index_rows(tokens, percent)
                for column, value in zip(out, (len(tokens), digest(raw), digest(raw, 7), least, rows.view(np.int64), digest(text.encode("utf-8", "surrogatepass"))), strict=True):
                    column.append(value)
            n, d1, d2, least, rows, d = out
            whole = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (d, d1, d2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), whole[0], pa.array(n, pa.int64()), *whole[1:], pa.array(least, pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "d", "n", "d1", "d2", "least", "rows"],
            )
        give_back()

    source = docs.select(id_or_least().alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return written(source.mapInArrow(made, "doc_id long, text_hash long, d long, n long, d1 long, d2 long, least long, rows array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link. ``sets`` lies in buckets of id and d, so the texts of a stay where they are until they meet those of b."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(f"{p}_text").to_pylist() for p in "ab")
            ok = pa.array([links(s, t, words, percent) for s, t in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["a_id", "a_d", "b_id", "b_d"]).filter(ok)
        give_back()

    flat = pairs.select(*(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("id", "d")))
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "d", "text")))
    ends = flat.select(F.col("b_id").alias("id"), F.col("b_d").alias("d")).distinct()
    both = flat.join(named(sets, "a"), ["a_id", "a_d"]).join(named(sets.join(ends, ["id", "d"], "left_semi"), "b"), ["b_id", "b_d"])
    return both.select("a_id", "a_d", "b_id", "b_d", "a_text", "b_text").mapInArrow(check, "a_id long, a_d long, b_id long, b_d long").select(_node("a"), _node("b"))


def _node(p: str) -> Column:
    return F.struct(F.col(f"{p}_id").alias("id"), F.col(f"{p}_d").alias("d")).alias(p)


def signature(tokens: np.ndarray, level: int) -> bytes:
    """Bitmap of the tokens whose lowest ``level`` bits are zero."""
    bits = np.zeros(BITS, np.uint8)
    mine = tokens.view(np.uint64)
    mine = mine[(mine & np.uint64((1 << level) - 1)) == 0]
    bits[(mine >> np.uint64(32)) % np.uint64(BITS)] = 1
    return np.packbits(bits).tobytes()


def level_of(n: int) -> int:
    return max(0, (max(n, 1) - 1).bit_length() - (FULL - 1).bit_length())


class Tree:
    """Signature tree over documents in order of size; level 0 holds the leaves' blocks of LEAF documents."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, comps: np.ndarray):
        order = np.lexsort((comps, sizes))
        self.at, self.sizes, self.bitmaps, self.comps = order, sizes[order], bitmaps[order], comps[order]
        weight = np.bitwise_count(self.bitmaps).sum(axis=1).astype(np.int64)
        starts = np.arange(0, len(order), LEAF)
        level = (
            np.bitwise_or.reduceat(self.bitmaps, starts), np.minimum.reduceat(weight, starts), self.sizes[starts], self.sizes[np.minimum(starts + LEAF, len(order)) - 1],
            np.minimum.reduceat(self.comps, starts), np.maximum.reduceat(self.comps, starts),
        )
        self.levels = [level]
        while len(level[0]) > 1:
            pairs = np.arange(0, len(level[0]), 2)
            last = np.minimum(pairs + 1, len(level[0]) - 1)
            level = (
                np.bitwise_or.reduceat(level[0], pairs), np.minimum.reduceat(level[1], pairs), level[2][pairs], level[3][last],
                np.minimum.reduceat(level[4], pairs), np.maximum.reduceat(level[5], pairs),
            )
            self.levels.append(level)


def dual_traversal(x: Tree, y: Tree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of document pairs of different components that may link, in batches; with ``same`` each pair once."""
    todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while todo:
        lx, i, ly, j = todo.pop()
        if same and lx == ly and i > j:
            continue
        a, b = x.levels[lx], y.levels[ly]
        if 100 * a[3][i] < percent * b[2][j] or 100 * b[3][j] < percent * a[2][i]:
            continue
        if a[4][i] == a[5][i] == b[4][j] == b[5][j]:
            continue
        shared = int(np.bitwise_count(a[0][i] & b[0][j]).sum())
        most = min(a[3][i] - max(0, a[1][i] - shared), b[3][j] - max(0, b[1][j] - shared))
        if (100 + percent) * most < percent * (a[2][i] + b[2][j]):
            continue
        if lx == 0 and ly == 0:
            p, q = np.arange(i * LEAF, min(len(x.at), (i + 1) * LEAF)), np.arange(j * LEAF, min(len(y.at), (j + 1) * LEAF))
            apart = np.bitwise_count(x.bitmaps[p][:, None] ^ y.bitmaps[q][None]).sum(axis=2).astype(np.int64)
            total = x.sizes[p][:, None] + y.sizes[q][None]
            ok = (100 + percent) * (total - apart) >= 2 * percent * total
            ok &= x.comps[p][:, None] != y.comps[q][None]
            if same and i == j:
                ok &= p[:, None] < q[None]
            u, v = np.nonzero(ok)
            if len(u):
                yield x.at[p[u]], y.at[q[v]]
        elif lx >= ly:
            todo += [(lx - 1, k, ly, j) for k in (2 * i, 2 * i + 1) if k < len(x.levels[lx - 1][0])]
        else:
            todo += [(lx, i, ly - 1, k) for k in (2 * j, 2 * j + 1) if k < len(y.levels[ly - 1][0])]


#: Up to so many nodes of a row, comparing all of them is cheaper than growing a tree.
SMALL = 48
_ROW = ["token", "i", "j"]


class _Batch:
    """The rows of some whole groups as arrays."""

    def __init__(self, pdf: pd.DataFrame):
        self.n, self.id, self.d = (pdf[c].to_numpy(np.int64) for c in ("n", "id", "d"))
        self.comp = pdf.groupby(["c_id", "c_d"], sort=False).ngroup().to_numpy(np.int64)
        self.level = np.array([level_of(n) for n in self.n.tolist()], np.int64)
        self.block = pdf["block"].to_numpy(np.int64)
        self.maps = [np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(len(pdf), BITS // 64) for c in ("own", "next")]
        self.token = pdf["token"].to_numpy(np.int64)
        self.carried = np.frombuffer(b"".join(pdf["carried"]), np.int64).reshape(len(pdf), -1)

    def may_link(self, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs pass the bounds of size and bitmaps."""
        total = self.n[p] + self.n[q]
        ok = (self.comp[p] != self.comp[q]) & (100 * np.minimum(self.n[p], self.n[q]) >= percent * np.maximum(self.n[p], self.n[q]))
        p, q, total, at = p[ok], q[ok], total[ok], np.flatnonzero(ok)
        # Bitmaps of unequal levels are compared at the higher one.
        up, uq = (self.level[p] < self.level[q])[:, None], (self.level[q] < self.level[p])[:, None]
        own, above = self.maps
        apart = np.bitwise_count(np.where(up, above[p], own[p]) ^ np.where(uq, above[q], own[q])).sum(axis=1, dtype=np.int64)
        return at[(100 + percent) * (total - apart) >= 2 * percent * total]

    def found_here(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs share no carried row smaller than the one that they are compared under, or none at all."""
        here = []
        for at in range(0, len(p), 1 << 15):
            x, y = self.carried[p[at : at + (1 << 15)]], self.carried[q[at : at + (1 << 15)]]
            both = np.where((x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0), x, np.iinfo(np.int64).max).min(axis=1)
            here.append((both == np.iinfo(np.int64).max) | (both == self.token[p[at : at + (1 << 15)]]))
        return np.concatenate(here) if here else np.zeros(0, bool)


def _large(batch: _Batch, rows: np.ndarray, i: int, j: int, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs between the blocks i and j of one index row, by signature trees of each level of size."""
    found = []

    def go(x: np.ndarray, y: np.ndarray, wx: int, wy: int, same: bool) -> None:
        if len(x) and len(y):
            trees = [Tree(batch.n[r], batch.maps[w][r], batch.comp[r]) for r, w in ((x, wx), (y, wy))]
            found.extend((x[p], y[q]) for p, q in dual_traversal(*trees, percent, same))

    for level in np.unique(batch.level[rows]):
        at, above = ([rows[(batch.level[rows] == v) & (batch.block[rows] == b)] for b in (i, j)] for v in (level, level + 1))
        go(at[0], at[1], 0, 0, i == j)
        go(at[0], above[1], 1, 0, False)
        if i != j:
            go(at[1], above[0], 1, 0, False)
    return found


def _search(percent: int):
    """Over rows sorted by group: pairs of nodes of different components that may link."""

    def pairs_of(pdf: pd.DataFrame) -> pd.DataFrame:
        batch = _Batch(pdf)
        keys = pdf[_ROW].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(pdf)]
        found, few = [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > SMALL:
                found += _large(batch, np.arange(a, b), int(keys[a, 1]), int(keys[a, 2]), percent)
            elif b - a > 1:
                u, v = np.triu_indices(b - a, 1)
                few.append((u + a, v + a))
        if few:
            p, q = (np.concatenate(x) for x in zip(*few, strict=True))
            ok = batch.may_link(p, q, percent)
            found.append((p[ok], q[ok]))
        p, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        here = batch.found_here(p, q)
        p, q = p[here], q[here]
        out = pd.DataFrame({"a_id": batch.id[p], "a_d": batch.d[p], "b_id": batch.id[q], "b_d": batch.d[q]})
        swap = (out["a_id"] > out["b_id"]) | ((out["a_id"] == out["b_id"]) & (out["a_d"] > out["b_d"]))
        out.loc[swap, ["a_id", "a_d", "b_id", "b_d"]] = out.loc[swap, ["b_id", "b_d", "a_id", "a_d"]].to_numpy()
        return out.drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the last group may go on in the next batch; a group has two blocks at most
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf[_ROW].iloc[-1]
            at = int((pdf[_ROW] == last).all(axis=1).to_numpy().argmax())
            held = pdf.iloc[at:].reset_index(drop=True)
            if at:
                yield pairs_of(pdf.iloc[:at])
        if held is not None and len(held):
            yield pairs_of(held)
        held = None
        give_back()

    return run


def _signed(words: int, percent: int):
    def above(t: np.ndarray) -> bytes:
        """The bitmap at the next level, if a linked set may be of that level; else one without bits, which packs well."""
        level = level_of(len(t))
        return signature(t, level + 1) if 100 * len(t) >= percent * (FULL << level) else bytes(BITS // 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [token_set(t, words) for t in pdf["text"]]
            carried = [np.r_[x, np.full(CARRIED - len(x), -1)].astype(np.int64).tobytes() for x in pdf["carried"]]
            yield pd.DataFrame({"id": pdf["id"], "d": pdf["d"], "own": [signature(t, level_of(len(t))) for t in tokens], "next": [above(t) for t in tokens], "carried": carried})
        give_back()

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, d, text of the nodes in ``ids`` (id, d), in buckets."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            d = np.array([digest(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield batch.filter(pa.array(d == batch.column("d").to_numpy()))
        give_back()

    source = docs.select(id_or_least().alias("id"), text_or_empty().alias("text")).join(ids, "id").select("id", "d", "text")
    return written_in_buckets(source.mapInArrow(same, "id long, d long, text string").dropDuplicates(["id", "d"]), "texts", "id", "d")


def _joined(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Written: doc_id (the smallest long for null), text_hash, d, n and component, the node that names the component (null without n-grams)."""
    with scratch(docs.sparkSession, "jaccard-join") as keep:
        return keep(_found(docs, words, percent), "joined")


def _found(docs: DataFrame, words: int, percent: int) -> DataFrame:
    base = documents(docs, words, percent)
    full = base.filter(F.col("n") > 0)
    classes = written(full.groupBy("n", "d1", "d2").agg(F.min(F.struct(F.col("doc_id").alias("id"), "d")).alias("node"), F.min("least").alias("least")), "classes")
    firsts = full.join(classes.select(F.col("node.id").alias("doc_id"), F.col("node.d").alias("d")), ["doc_id", "d"], "left_semi").dropDuplicates(["doc_id", "d"])
    # Rows whose 48 bits meet by chance are counted and verified like the rest. Sizes come back from the classes, so both readers of firsts take the same columns.
    rows = firsts.select("doc_id", "d", F.explode("rows").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    live = written(rows.join(shared, "token").select(F.struct(F.col("doc_id").alias("id"), "d").alias("node"), "token", "df"), "rows")
    release(docs.sparkSession)
    counted = live.groupBy("node").agg(F.count("*").alias("rows")).join(classes.select("node", "n", "least"), "node")
    nodes = written(counted.filter(F.col("rows") >= F.col("least")).select("node", "n", "least"), "nodes")
    ids = nodes.select(F.col("node.id").alias("id"), F.col("node.d").alias("d"))
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = _texts(docs, F.broadcast(ids) if small else ids)
    kept = written(live.join(nodes.select("node", "least"), "node"), "kept-rows")
    release(docs.sparkSession)

    def star(hubs: DataFrame, comps: DataFrame | None) -> DataFrame:
        """Each node's verified link to the hub it shares most rows with, if that is in another component."""
        votes = hubs.filter(F.col("node") != F.col("hub")).groupBy("node", "hub").agg(F.count("*").alias("votes"))
        best = votes.groupBy("node").agg(F.max(F.struct("votes", "hub")).alias("best")).select(F.col("node").alias("a"), F.col("best.hub").alias("b"))
        if comps is not None:
            for p in "ab":
                best = best.join(comps.select(F.col("node").alias(p), F.col("component").alias(f"{p}_c")), p, "left").withColumn(f"{p}_c", F.coalesce(f"{p}_c", p))
            best = best.filter(F.col("a_c") != F.col("b_c")).select("a", "b")
        return written(_verified(best, sets, words, percent), "links")

    found_links = star(kept.join(kept.groupBy("token").agg(F.min("node").alias("hub")), "token"), None)
    comps = components(found_links)
    turn = F.struct(F.xxhash64("node").alias("turn"), "node")
    other = kept.groupBy("token").agg(F.min(turn).alias("first")).select("token", F.col("first.node").alias("hub"))
    found_links = found_links.union(star(kept.join(other, "token"), comps))
    comps = components(found_links)

    # What the stars left: rows that nodes of different components share.
    own = nodes.join(comps, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    common_first = Window.partitionBy("node").orderBy(F.col("df").desc(), "token")
    rarest = kept.withColumn("place", F.row_number().over(common_first)).filter(F.col("place") >= F.col("least"))
    open_rows = rarest.select("node", "token", "df").join(own, "node")
    mixed = open_rows.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter(F.col("lo") != F.col("hi"))
    todo = written(open_rows.join(mixed.select("token", "m"), "token"), "open-rows")
    first = F.slice(F.array_sort(F.collect_list(F.struct("df", "token"))), 1, CARRIED)["token"]
    needed = todo.groupBy(F.col("node.id").alias("id"), F.col("node.d").alias("d")).agg(first.alias("carried"))
    signed = sets.join(needed, ["id", "d"]).select("id", "d", "text", "carried").mapInPandas(_signed(words, percent), "id long, d long, own binary, next binary, carried binary")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = todo.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK).cast("long")).cast("int")})
    # Block k meets every block: as the first of the pair those at or above it, as the second those below.
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    flat = met.select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n",
        F.col("node.id").alias("id"), F.col("node.d").alias("d"), F.col("component.id").alias("c_id"), F.col("component.d").alias("c_d"),
    ).join(signed, ["id", "d"])
    grouped = flat.repartition(F.col("token"), F.col("i"), F.col("j")).sortWithinPartitions(*_ROW)
    found = grouped.mapInPandas(_search(percent), "a_id long, a_d long, b_id long, b_d long").distinct()
    pairs = found.select(F.struct(F.col("a_id").alias("id"), F.col("a_d").alias("d")).alias("a"), F.struct(F.col("b_id").alias("id"), F.col("b_d").alias("d")).alias("b"))
    rest = written(_verified(written(pairs, "pairs"), sets, words, percent), "links")
    if not rest.isEmpty():
        comps = components(found_links.union(rest))

    named = classes.join(comps, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component"))
    return base.select("doc_id", "text_hash", "d", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left").select("doc_id", "text_hash", "d", "n", "component")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    out = _joined(docs, words, percent)
    return out.select(shown_id(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown_id(F.coalesce("component.id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the smallest document of each component; rows that repeat an id and a text stay once."""
    out = _joined(docs, words, percent)
    stays = F.col("component").isNull() | (F.col("doc_id") == F.col("component.id")) & (F.col("d") == F.col("component.d"))
    first = out.filter(stays).select(F.col("doc_id").alias("_codrel_id"), F.col("text_hash").alias("_codrel_hash")).distinct()
    keyed = docs.withColumns({"_codrel_id": id_or_least(), "_codrel_hash": F.xxhash64(text_or_empty())})
    kept = keyed.join(first, ["_codrel_id", "_codrel_hash"], "left_semi").dropDuplicates(["_codrel_id", "_codrel_hash"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
