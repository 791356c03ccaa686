"""N-gram Jaccard join over token-combination prefixes.

A document's tokens are its distinct shingles of WORDS words. Documents x and y link when 100 |x & y| >= 75 |x | y|, so at
most n - ceil(0.75 n) tokens of x are not in y. Tokens have one global order, rare ones before frequent ones. A prefix is
extended until that many removals, made anywhere, leave one signature whole: a single rare token, or a combination of two
frequent tokens of one class. Then linked documents share a signature, and frequent tokens alone never make candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import BASE, as_long, buffers, chunks, discard, doc_id, give_back, keyed, lean, materialise, mix, n_parts, word_hashes, words
from lociframe.llm.components import components
from lociframe.llm.repeats import repeated

WORDS, SIMILARITY = 5, 75
CELLS, CHUNK_CELLS = 1 << 18, 1 << 13  # counters of the frequency sketch, whatever the corpus; counters in one row of it


def shingle_sets(text: pa.Array, n_words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes; with fewer words, the whole sequence is the only shingle."""
    raw, offs = buffers(text)
    for i, j in chunks(offs):
        part = raw[offs[i] : offs[j]]
        start, end, first = words(part, offs[i : j + 1] - offs[i])
        h = word_hashes(part, start, end, fold=True)
        all_ = np.zeros(max(0, len(h) - n_words + 1), np.uint64)
        for w in range(n_words):
            all_ = all_ * BASE + h[w : w + len(all_)]
        all_ = mix(all_)
        for r in range(i, j):
            a, b = first[r - i], first[r - i + 1]
            if b - a >= n_words:
                yield r, np.unique(all_[a : b - n_words + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for x in h[a:b]:
                    one = mix(one * BASE + x)
                yield r, one
            else:
                yield r, np.zeros(0, np.uint64)


def set_class(tokens: np.ndarray) -> int:
    """One number for a set of tokens, whatever their order."""
    return int(as_long(mix(np.array([mix(tokens).sum() + np.uint64(len(tokens))], np.uint64)))[0]) if len(tokens) else 0


def scan(docs: DataFrame, made: list[str] | None = None) -> DataFrame:
    """One pass: a row (k, n, c) per document, and the token counts as rows (part, cells), added up within each task."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            n, c = [], []
            for _, tokens in shingle_sets(batch.column("text")):
                n.append(len(tokens))
                c.append(set_class(tokens))
                np.add.at(counts, (tokens >> np.uint64(46)).astype(np.int64), 1)
            m = len(n)
            yield pa.record_batch([batch.column("k"), pa.array(n, pa.int32()), pa.array(c, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["k", "n", "c", "part", "cells"])
        parts = range(0, CELLS, CHUNK_CELLS)
        m = len(parts)
        yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(list(parts), pa.int32()), pa.array([counts[p : p + CHUNK_CELLS].tobytes() for p in parts], pa.binary())], names=["k", "n", "c", "part", "cells"])

    return materialise(docs.mapInArrow(lean(run), "k long, n int, c long, part int, cells binary"), made)


def token_counts(scanned: DataFrame) -> np.ndarray:
    """The sketch: how many tokens fell in each of CELLS cells. Its size is fixed."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, b in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                total[p] = total.get(p, 0) + np.frombuffer(b, np.int64)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "cells"])

    out = np.zeros(CELLS, np.int64)
    cells = scanned.where("part is not null").select("part", "cells")
    for p, b in cells.repartition(min(CELLS // CHUNK_CELLS, n_parts(scanned.sparkSession)), "part").mapInArrow(lean(add), "part int, cells binary").collect():
        out[p : p + CHUNK_CELLS] += np.frombuffer(b, np.int64)
    return out


def removals(n: int, similarity: int = SIMILARITY) -> int:
    """How many of n tokens a linked set may lack at most."""
    return n - -(-similarity * n // 100)


def level_start(level: int) -> int:
    return 1 << level if level > 3 else 9


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent_from: float, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set, single tokens and combinations: linked sets share one. Sizes fall in levels; a set near the
    next level also gives that one's combinations."""
    n, none = len(tokens), np.zeros(0, np.uint64)
    need = removals(n, similarity) + 1
    cell = counts[(tokens >> np.uint64(46)).astype(np.int64)]
    by = np.argsort(cell, kind="stable")
    tokens, n_rare = tokens[by], int(np.searchsorted(cell[by], frequent_from))
    rare, many = tokens[:n_rare], tokens[n_rare:]
    if n_rare >= need:
        return mix(rare[:need]), none
    level = n.bit_length() - 1 if n > 8 else 0
    above = 3 if level == 0 else level + 1
    single, out = [rare], [none]
    for lv in (level, above) if 100 * n >= similarity * level_start(above) else (level,):
        left = need - n_rare
        if lv == 0:
            single.append(many[:left])
            continue
        cls = ((many >> np.uint64(16)) % np.uint64(max(1, (1 << lv) // 8))).astype(np.int64)
        _, firsts = np.unique(cls, return_index=True)
        kills = np.ones(len(many), np.int64)
        kills[firsts] = 0
        stop = int(np.searchsorted(np.cumsum(kills), left)) + 1
        by = np.argsort(cls[:stop], kind="stable")
        c, t = cls[:stop][by], many[:stop][by]
        for gap in range(1, int(np.bincount(c).max())):
            same = c[gap:] == c[:-gap]
            if not same.any():
                break
            a, b = t[:-gap][same], t[gap:][same]
            out.append(mix(mix(np.minimum(a, b)) * BASE + np.maximum(a, b) + np.uint64(lv)))
    return mix(np.concatenate(single)), mix(np.unique(np.concatenate(out)))


def shared_signatures(docs: DataFrame, counts: np.ndarray, made: list[str] | None = None) -> DataFrame:
    """(sig, c, n, p): signatures that at least two different sets have. n is the set's size, p twice the number of single
    tokens among the set's signatures, plus 1 if this signature is one."""
    mean = counts.sum() / CELLS
    shared = docs.sparkSession.sparkContext.broadcast((counts, mean + 8 * np.sqrt(mean) + 32))

    def run(batch):
        counts, frequent_from = shared.value
        seen: set[int] = set()
        sigs, cs, ns, ps = [np.zeros(0, np.uint64)], [], [], [np.zeros(0, np.int32)]
        for _, tokens in shingle_sets(batch.column("text")):
            if len(tokens) and (c := set_class(tokens)) not in seen:
                seen.add(c)
                single, combined = signatures(tokens, counts, frequent_from)
                sigs += [single, combined]
                ps += [np.full(len(single), 2 * len(single) + 1, np.int32), np.full(len(combined), 2 * len(single), np.int32)]
                cs.append(c)
                ns.append(len(tokens))
        m = [len(x) + len(y) for x, y in zip(sigs[1::2], sigs[2::2], strict=True)]
        yield [as_long(np.concatenate(sigs)), np.repeat(np.array(cs, np.int64), m), np.repeat(np.array(ns, np.int32), m), np.concatenate(ps)]

    return materialise(repeated(docs, run, [("sig", "i8"), ("c", "i8"), ("n", "i4"), ("p", "i4")]), made)


LEAST_BITS, MOST_BITS, SLICES = 20, 27, 8  # logarithms of the filter's size, which is at most 16 MB; tasks that build it


def _slots(k: np.ndarray, bits: int) -> np.ndarray:
    return (mix(k.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap that has the hash of every id in column k and others by chance, and the logarithm of its size, which follows
    the number of ids up to a bound; a full filter lets more sets through and loses none."""
    bits = min(max(LEAST_BITS, (16 * ids.count()).bit_length()), MOST_BITS)
    width = (1 << bits) // SLICES

    def hashed(batches):
        for batch in batches:
            at = _slots(batch.column("k").to_numpy(), bits)
            yield pa.record_batch([pa.array((at // width).astype(np.int32)), pa.array(at % width)], names=["slice", "at"])

    def run(batches):
        own, number = np.zeros(width, bool), None
        for batch in batches:
            if batch.num_rows:
                own[batch.column("at").to_numpy()], number = True, batch.column("slice")[0].as_py()
        if number is not None:
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["slice", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for number, b in ids.mapInArrow(hashed, "slice int, at long").repartitionById(SLICES, "slice").mapInArrow(run, "slice int, bits binary").collect():
        out[number * (width // 8) : (number + 1) * (width // 8)] = np.frombuffer(b, np.uint8)
    return out, bits


def token_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, tokens) for at least the classes in wanted (c): a set as 48 bits a token."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.join(classes, "c").select("k")))

    def run(batches):
        packed, bits = shared.value
        for batch in batches:
            at = _slots(batch.column("k").to_numpy(), bits)
            part = batch.filter(pa.array((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            seen, out = set(), []
            for _, tokens in shingle_sets(part.column("text")):
                if len(tokens) and (c := set_class(tokens)) not in seen:
                    seen.add(c)
                    out.append((c, (tokens >> np.uint64(32)).astype(np.uint32).tobytes() + (tokens >> np.uint64(16)).astype(np.uint16).tobytes()))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["c", "tokens"])

    return docs.mapInArrow(lean(run), "c long, tokens binary")


def tokens_of(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return (np.frombuffer(blob, np.uint32, n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(blob, np.uint16, n, 4 * n)


TOGETHER = 200_000  # tokens of a hub's members that are compared with it in one group


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, made: list[str] | None = None, similarity: int = SIMILARITY) -> DataFrame:
    """Edges (a, b) for those of pairs (hub, c, n) of classes whose sets reach the similarity; n: tokens of c.

    A hub's members are dealt by hash into groups of about TOGETHER tokens, and its own set goes once to each group."""
    groups = pairs.groupBy("hub").agg(F.ceil(F.sum("n") / TOGETHER).alias("groups"))
    dealt = materialise(pairs.join(groups, "hub").select("hub", F.pmod(F.xxhash64("c"), F.col("groups")).alias("g"), "c"), made)
    sides = dealt.unionByName(dealt.select("hub", "g", F.col("hub").alias("c")).distinct())
    wanted = materialise(sides.select("c").distinct(), made)

    def compare(batches):
        for batch in batches:
            edges = []
            for hub, sets in zip(batch.column("hub").to_pylist(), batch.column("sets").to_pylist(), strict=True):
                own = {s["c"]: tokens_of(s["tokens"]) for s in sets}
                x = own.pop(hub)
                for c, y in own.items():
                    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if 100 * shared >= similarity * (len(x) + len(y) - shared):
                        edges.append((min(hub, c), max(hub, c)))
            yield pa.record_batch([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    found = sides.join(token_sets(docs, classes, wanted), "c")
    return found.groupBy("hub", "g").agg(F.collect_list(F.struct("c", "tokens")).alias("sets")).mapInArrow(lean(compare), "a long, b long")


BLOCK, BLOCK_TOKENS = 1000, 400_000  # sets of a cluster, and tokens in them, that meet in one task, about; larger clusters meet block by block
DENSE = 32  # tokens that so many sets share are counted by matrix products


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens every two of the sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    if not len(tokens):
        return np.zeros((m, m), np.float32)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    first = np.flatnonzero(new)
    df = np.diff(np.append(first, len(tokens)))
    out = np.zeros(m * m, np.float32)
    for d in np.unique(df[(df > 1) & (df < DENSE)]).tolist():
        at = first[df == d]
        i, j = np.triu_indices(d, 1)
        for lo in range(0, len(at), max(1, 2_000_000 // len(i))):
            some = owner[at[lo : lo + max(1, 2_000_000 // len(i))][:, None] + np.arange(d)]
            key, n = np.unique((some[:, i] * m + some[:, j]).ravel(), return_counts=True)
            out[key] += n
    out = out.reshape(m, m)
    out += out.T
    dense = np.flatnonzero(df >= DENSE)
    for lo in range(0, len(dense), 2048):
        part = dense[lo : lo + 2048]
        table = np.zeros((m, len(part)), np.float32)
        rows = np.concatenate([owner[first[x] : first[x] + df[x]] for x in part])
        table[rows, np.repeat(np.arange(len(part)), df[part])] = 1
        out += table @ table.T
    return out


def cluster_links(docs: DataFrame, classes: DataFrame, named: DataFrame, clusters: DataFrame, made: list[str] | None = None, similarity: int = SIMILARITY) -> DataFrame:
    """Edges (a, b) that connect what links connect among sets that share a signature and differ in label.

    named: c, n, p, u, singles, combined, label of every set; clusters: sig, hub. Signatures with one hub make a cluster, so
    sets that share many signatures meet once or a few times only; the hub itself has been compared with all before. Members
    that by two bounds cannot be similar to any other drop. The rest of a cluster's sets with different labels are compared,
    block against block, and a spanning forest of the links is returned: at most one edge per set.
    """
    members = materialise(signed(named, "label").join(clusters, "sig").where("c <> hub").select("hub", "c", "n", "u", "label").distinct(), made)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS))
    sizes = members.groupBy("hub").agg(blocks.alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("hub", "blocks")
    members = members.join(sizes, "hub").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")))
    members = members.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("hub", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "own", "c", "n", "u", "label")
    members = members.repartition("hub", "i", "j")  # else the blocks of a hub stay in the task that counted them

    def hopeful(table: pa.Table) -> pa.Table:
        """Members that by the bounds may be similar to one of another label."""
        n, u, label, own = (table.column(x).to_numpy() for x in ("n", "u", "label", "own"))
        most = np.minimum(np.maximum((n - u)[:, None], (n - u)[None, :]), np.minimum(n[:, None], n[None, :]))
        may = (100 * most >= similarity * (n[:, None] + n[None, :] - most)) & (label[:, None] != label[None, :])
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            may &= own[:, None] != own[None, :]
        return table.filter(pa.array(may.any(1)))

    members = materialise(members.groupBy("hub", "i", "j").applyInArrow(hopeful, members.schema), made)

    def closer(table: pa.Table) -> pa.Table:
        """The same by the single tokens that two prefixes share: beyond them, at most n - p tokens of one are in the other."""
        n, p, label, own = (table.column(x).to_numpy() for x in ("n", "p", "label", "own"))
        common = shared_counts([np.array(x, np.int64).view(np.uint64) for x in table.column("singles").to_pylist()])
        most = np.minimum(np.maximum((n - p)[:, None], (n - p)[None, :]) + common, np.minimum(n[:, None], n[None, :]))
        may = (100 * most >= similarity * (n[:, None] + n[None, :] - most)) & (label[:, None] != label[None, :])
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            may &= own[:, None] != own[None, :]
        return table.filter(pa.array(may.any(1))).select(["hub", "i", "j", "own", "c", "label"])

    members = materialise(members.join(named.select("c", "p", "singles"), "c").groupBy("hub", "i", "j").applyInArrow(closer, members.drop("n", "u").schema), made)
    wanted = materialise(members.select("c").distinct(), made)

    def compare(table: pa.Table) -> pa.Table:
        c, at = np.unique(table.column("c").to_numpy(), return_index=True)
        table = table.take(pa.array(at))
        label, own = table.column("label").to_numpy(), table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = [tokens_of(b) for b in table.column("tokens").to_pylist()]
        n = np.array([len(s) for s in sets], np.float32)
        both = shared_counts(sets)
        near = (100 * both >= similarity * (n[:, None] + n[None, :] - both)) & (label[:, None] != label[None, :])
        if i != j:
            near &= own[:, None] != own[None, :]
        seen, edges = np.zeros(len(c), bool), []
        for s in np.flatnonzero(near.any(1)):
            if seen[s]:
                continue
            seen[s], front = True, [s]
            while len(front):
                x = front.pop()
                fresh = np.flatnonzero(near[x] & ~seen)
                seen[fresh] = True
                edges += [(c[x], c[y]) for y in fresh]
                front += fresh.tolist()
        del sets, both, near
        if len(c) > BLOCK // 4:
            give_back()
        return pa.table({"a": pa.array([min(e) for e in edges], pa.int64()), "b": pa.array([max(e) for e in edges], pa.int64())})

    found = members.join(token_sets(docs, classes, wanted), "c")
    return found.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long")


def possible(most, n, n2):
    """Whether sets of sizes n and n2 can reach the similarity if they share `most` tokens or fewer."""
    most = F.least(most, n, n2)
    return 100 * most >= SIMILARITY * (n + n2 - most)


def signed(sets: DataFrame, *more: str) -> DataFrame:
    """A row (sig, c, n, u, ...) for each signature of each set."""
    return sets.select("c", "n", "u", *more, F.explode(F.concat("singles", "combined")).alias("sig"))


def links(docs: DataFrame, classes: DataFrame, shared: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Edges (a, b) between classes that connect what all links connect, without a row for each pair of a group.

    First every set is compared with one hub of each of its signatures, the set with the fewest tokens of its own. Of two
    sets, the one whose prefix ends first has each of its single tokens in the other's prefix or not in the other set at
    all; so with u of x's single tokens in nobody's prefix, at most n - u tokens of x are shared, and with p single tokens of
    which `common` are the other's too, at most n - p + common. Pairs that cannot be similar by either bound are left out
    before any set is read. What several components still share signatures is compared in clusters.
    """
    single = F.col("p") % 2 == 1
    sets = shared.groupBy("c").agg(F.max("n").cast("long").alias("n"), F.max(F.floor(F.col("p") / 2)).alias("p"), F.collect_set(F.when(single, F.col("sig"))).alias("singles"), F.collect_set(F.when(~single, F.col("sig"))).alias("combined"))
    sets = materialise(sets.withColumn("u", F.col("p") - F.size("singles")), made)
    key = F.struct("u", "n", "c")
    hubs = signed(sets).groupBy("sig").agg(F.min(key).alias("key"))
    hubs = hubs.select("sig", F.col("key.c").alias("hub"), F.col("key.n").alias("n2"), F.col("key.u").alias("u2"))
    n2, u2 = F.col("n2"), F.col("u2")
    star = signed(sets).join(hubs, "sig").where("c <> hub").where(possible(F.greatest(F.col("n") - F.col("u"), n2 - u2), F.col("n"), n2))
    star = star.select("hub", "c").distinct().join(sets.select("c", "n", "p", "singles"), "c")
    star = star.join(sets.select(F.col("c").alias("hub"), F.col("n").alias("n2"), F.col("p").alias("p2"), F.col("singles").alias("singles2")), "hub")
    common = F.size(F.array_intersect("singles", "singles2"))
    star = star.where(possible(F.greatest(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) + common, F.col("n"), F.col("n2")))
    edges = materialise(verified(docs, classes, materialise(star.select("hub", "c", "n"), made), made), made)
    named = materialise(sets.join(components(edges), F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("component", "c")).drop("node", "component"), made)
    live = signed(named, "label").groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("c", key).alias("hub"))
    clusters = materialise(live.where("lo <> hi").select("sig", "hub"), made)
    return edges if clusters.isEmpty() else edges.unionByName(cluster_links(docs, classes, named, clusters, made))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Null or empty text and text without words have an empty set,
    which links with nothing, not even another: component_id is the own doc_id. A null doc_id counts as smaller than all
    others; a component that contains one has a null component_id. Rows that share a doc_id are separate documents with
    that id. Other columns are ignored. Sets are compared as 64-bit hashes of shingles.
    """
    own, made = keyed(docs), []
    scanned = scan(own)
    rows = scanned.where("part is null").select("k", "n", "c")
    classes = materialise(rows.where("n > 0").groupBy("c").agg(F.min("k").alias("k")))
    label = components(links(own, classes, shared_signatures(own, token_counts(scanned), made), made))
    named = materialise(classes.join(label, F.col("c") == F.col("node"), "left").select("c", "k", F.coalesce("component", "c").alias("label")))
    ids = materialise(named.join(named.groupBy("label").agg(F.min("k").alias("first")), "label").select("c", "first"))
    discard(docs.sparkSession, made)
    out = rows.where("n > 0").join(ids, "c").select("k", "n", "first").unionByName(rows.where("n = 0").select("k", "n", F.col("k").alias("first")))
    return out.select(doc_id(), F.col("n").cast("long").alias("n_shingles"), doc_id("first").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
