"""N-gram Jaccard join by prefix trees.

A document is the set of its word n-grams; sets whose Jaccard similarity reaches a limit
are linked, and components of links are named.  Nothing is missed: every step before the
trees only sets apart what cannot be linked.

1. Sets are ordered by one global order, n-grams that are common in a bounded sample
   last.  Two sets that reach the limit share n-grams within short prefixes of that order;
   sets that share too few of theirs with any other set are alone.
2. What is left forms pools: sets whose prefixes share two neighbours of the order (see
   ``least_shared``), transitively.
   A pool's sets meet in one task, stored in a trie, most frequent n-gram first, so that
   near copies share one long path.  Every set is held against the trie: paths carry the
   partial overlap, and a subtree is left as soon as the n-grams that remain on either
   side, or its sets' sizes, cannot reach the limit any more, or all of it is linked already.
3. A pool beyond the bound of a task is cut into slices by size and hash.  First every
   slice, together with leaders chosen from all slices, finds its links; then the sets
   outside the pool's largest component are held, in blocks, against the slices whose
   sizes they can match.  So a large group of near copies costs about its size, and no
   pair of sets in different components stays untested.

Links are only sought between sets that are not connected yet: a spanning forest is
enough for components, and no group can emit more links than it has sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm._common import bitmap_of, compact, durable, in_bitmap, name, small_side
from vigil.llm.simhash_mih import connected

SEED = 42
#: Tokens of one node of a trie: a long run without a branch is cut there, to be left early.
STEP = 32
#: Cells of the table that tells which query holds which token.
CELLS = 32_000_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; fewer words are one n-gram, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    body, k, hashed = b" ".join(words), min(size, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[:-1].tolist()][: len(words) - k + 1]
    own = {body[a:b] for a, b in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)}
    return np.sort(np.fromiter((hashed(x, SEED) for x in own), np.uint64, len(own)))


#: From this limit on, linked sets share two neighbours of the order (below it, one n-gram).
NEIGHBOURS = 75


def least_shared(n, percent: int):
    """How many n-grams, and so far as the order goes, two sets share within their prefixes (``prefix_size``) if the smaller has ``n``.

    Linked sets differ in at most k = n (100 - p) / p n-grams, each of which parts two shared
    ones that would be neighbours in its set's order: of the first k + 2 that they share, two
    are neighbours in both.  Below ``NEIGHBOURS`` % sets need not share so many.
    """
    if isinstance(n, Column):
        return F.floor(n * (100 - percent) / percent).cast("long") + 2 if percent >= NEIGHBOURS else n - F.ceil(percent * n / 100).cast("long") + 1
    return n * (100 - percent) // percent + 2 if percent >= NEIGHBOURS else n - -(-percent * n // 100) + 1


def prefix_size(n: int, percent: int) -> int:
    """Places of the order that hold the first ``least_shared`` n-grams that a set of ``n`` shares with a linked one: all but p % of it can come before the last."""
    return min(n, n - -(-percent * n // 100) + least_shared(n, percent))


class Trie:
    """Distinct sets of tokens as paths; ``order`` gives the sets' places in lexicographic order."""

    def __init__(self, sets: list[np.ndarray]):
        flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
        by_count = np.empty(len(counts), np.int64)
        by_count[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        ends = np.cumsum(sizes)
        ranked = [np.sort(x).astype(np.int32) for x in np.split(by_count[ids], ends[:-1])]
        keys = [r.astype(">u4").tobytes() for r in ranked]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        self.sets = [ranked[i] for i in self.order]
        self.sizes, self.vocabulary = sizes[self.order], len(counts)
        self._build()

    def _build(self) -> None:
        sets, m = self.sets, len(self.sets)
        shared = np.zeros(m + 1, np.int64)
        for i in range(1, m):
            k = min(len(sets[i - 1]), len(sets[i]))
            differ = sets[i - 1][:k] != sets[i][:k]
            shared[i] = int(differ.argmax()) if differ.any() else k
        tokens, depth, low, high, ends, kids = [], [], [], [], [], []
        roots, stack = [], [(0, m, 0, None)]
        while stack:
            a, b, at, above = stack.pop()
            own = roots if above is None else kids[above]
            same = int(shared[a + 1 : b].min()) if b - a > 1 else len(sets[a])
            for start in range(at, same, STEP):
                piece = sets[a][start : min(start + STEP, same)]
                own.append(len(depth))
                above = len(depth)
                own = []
                kids.append(own)
                tokens.append(np.pad(piece, (0, STEP - len(piece)), constant_values=self.vocabulary))
                depth.append(start + len(piece))
                low.append(a)
                high.append(b)
                ends.append(-1)
            if len(sets[a]) == same:  # the shortest path ends here; no other does, as sets are distinct
                ends[above] = a
                a += 1
            if a < b:
                cuts = [a, *(np.flatnonzero(shared[a + 1 : b] == same) + a + 1).tolist(), b]
                stack += [(x, y, same, above) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        self.tokens, self.roots = np.array(tokens, np.int32).reshape(-1, STEP), np.array(roots, np.int64)
        self.depth, self.low, self.high, self.ends = (np.array(x, np.int64) for x in (depth, low, high, ends))
        self.last = np.where(self.tokens == self.vocabulary, -1, self.tokens).max(axis=1).astype(np.int64)
        self.least = np.array([self.sizes[a:b].min() for a, b in zip(low, high, strict=True)], np.int64)
        self.most = np.array([self.sizes[a:b].max() for a, b in zip(low, high, strict=True)], np.int64)
        self.first_kid = np.cumsum([0, *map(len, kids)])
        self.kids = np.array([k for own in kids for k in own], np.int64)

    def links(self, asked: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """A forest of links (places of sets) that joins the ``asked`` sets to whatever they reach and isn't joined yet.

        ``label`` (changed here): the component of every set so far.
        """
        every, found = bool(asked.all()), []
        queries = np.flatnonzero(asked)
        width = max(1, min(64, CELLS // (self.vocabulary + 1)))
        for at in range(0, len(queries), width):
            found += self._search(queries[at : at + width], every, label, percent)
        return found

    def _search(self, queries: np.ndarray, every: bool, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
        found = []
        holds = np.zeros((len(queries), self.vocabulary + 1), bool)
        for i, q in enumerate(queries):
            holds[i, self.sets[q]] = True
        n, starts = self.sizes[queries], np.cumsum(np.r_[0, self.sizes[queries]])
        ranks = np.concatenate([i * (self.vocabulary + 1) + self.sets[q] for i, q in enumerate(queries)])  # ascending
        changes = np.cumsum(np.r_[0, label[1:] != label[:-1]])
        q, node = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), self.roots, indexing="ij"))
        overlap = np.zeros(len(q), np.int64)
        while len(q):
            # Sets' sizes, what is linked already, and pairs that the other set has tested.
            ok = (100 * self.most[node] >= percent * n[q]) & (100 * n[q] >= percent * self.least[node])
            ok &= (changes[self.low[node]] != changes[self.high[node] - 1]) | (label[self.low[node]] != label[queries[q]])
            if every:
                ok &= self.high[node] - 1 > queries[q]
            q, node, overlap = q[ok], node[ok], overlap[ok]
            overlap = overlap + holds[q[:, None], self.tokens[node]].sum(axis=1)
            # At the most, all that is left on the longer path is shared; of the query, only tokens after the path's last.
            rest = starts[q + 1] - np.searchsorted(ranks, q * (self.vocabulary + 1) + self.last[node], "right")
            best = overlap + np.minimum(self.most[node] - self.depth[node], rest)
            ok = (100 + percent) * (overlap + self.most[node] - self.depth[node]) >= percent * (n[q] + self.most[node])
            ok &= (100 + percent) * best >= percent * (n[q] + np.maximum(self.least[node], self.depth[node]))
            q, node, overlap = q[ok], node[ok], overlap[ok]
            end = self.ends[node]
            full = np.flatnonzero((end >= 0) & ((100 + percent) * overlap >= percent * (n[q] + self.depth[node])))
            for i in full.tolist():
                a, b = int(queries[q[i]]), int(end[i])
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    found.append((a, b))
            number = self.first_kid[node + 1] - self.first_kid[node]
            at = np.repeat(self.first_kid[node] - np.r_[0, np.cumsum(number)[:-1]], number) + np.arange(number.sum())
            q, overlap, node = np.repeat(q, number), np.repeat(overlap, number), self.kids[at]
        return found


def forest(nodes: list, sets: list[np.ndarray], labels: list, asked: list[bool], percent: int) -> list[tuple]:
    """Links (pairs of ``nodes``) among sets that start in components ``labels``; only ``asked`` sets are held against the rest."""
    if len(nodes) < 2 or not any(asked):
        return []
    firsts, equal = {}, []
    for i, own in enumerate(sets):
        at = firsts.setdefault(own.tobytes(), i)
        if at != i:
            equal.append((at, i))
    if equal:  # equal sets are one path of a trie
        links, labels, asked = [], list(labels), list(asked)
        for at, i in equal:
            if labels[at] != labels[i]:
                links.append((nodes[at], nodes[i]))
                labels = [labels[at] if x == labels[i] else x for x in labels]
            asked[at] |= asked[i]
        own = list(firsts.values())
        return links + forest([nodes[i] for i in own], [sets[i] for i in own], [labels[i] for i in own], [asked[i] for i in own], percent)
    if len(nodes) == 2:
        n, both = len(sets[0]) + len(sets[1]), len(np.intersect1d(*sets, assume_unique=True))
        return [tuple(nodes)] if labels[0] != labels[1] and (100 + percent) * both >= percent * n else []
    trie = Trie(sets)
    label = np.unique([labels[i] for i in trie.order], return_inverse=True)[1]
    found = trie.links(np.array(asked)[trie.order], label, percent)
    return [(nodes[trie.order[a]], nodes[trie.order[b]]) for a, b in found]


def common_ngrams(texts: DataFrame, size: int, sample_texts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of n-grams that at least three of about ``sample_texts`` texts hold, and how many do: at most ``most``, the commonest.

    They only order the sets: another sample costs other work, and changes no result.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text.as_py(), size).view(np.int64))], ["token"])

    every, n = 1 << 30, texts.count()
    part = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) < int(every * min(1.0, sample_texts / max(n, 1)))).distinct()
    held = durable(part.mapInArrow(hashes, "token long").groupBy("token").agg(F.count("*").alias("held")).where("held > 2"))
    limit, left = 0, most
    for r in held.groupBy(F.least("held", F.lit(1000)).alias("held")).agg(F.count("*").alias("n")).orderBy(F.desc("held")).collect():
        left -= r.n
        if left < 0:
            limit = r.held + 1
            break
    found = held.where(F.col("held") >= limit).toArrow()
    tokens, counts = found.column("token").to_numpy().view(np.uint64), found.column("held").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def hub_pairs(held: DataFrame, by: str) -> DataFrame:
    """a, b: every ``nid`` with the smallest one that shares a value of ``by`` with it."""
    hubs = held.groupBy(by).agg(F.min("nid").alias("a"), F.max("nid").alias("high")).where("a <> high").select(by, "a")
    return held.join(hubs, by).where("a <> nid").select("a", F.col("nid").alias("b")).distinct()


def pools_of(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``nodes`` that are in any pair, with pool: what pairs (a, b of nid) connect."""
    roots = connected(pairs)
    pools = durable(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("id"), F.col("root").alias("pool")))
    return durable(nodes.join(pools, F.col("nid") == F.col("id")).drop("id"))


def pool_roots(pooled: DataFrame, sets: DataFrame, percent: int, *, task_tokens: int = 2_000_000, leaders: int = 512, broadcast_rows: int = 200_000) -> DataFrame:
    """node, root: components of the links at ``percent`` % among the sets of each pool (roots and single nodes have no row).

    ``pooled``: node, nid (a hash of it), n, pool; ``sets``: node, own (distinct hashes, not empty).
    """
    # Where each set goes: the whole pool is one task's, or its sizes' classes are cut into slices.
    pooled = pooled.select("node", "nid", "n", "pool")
    whole = pooled.groupBy("pool").agg((F.sum("n") > task_tokens).alias("large"))
    class_of = F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))).otherwise(0).cast("long")
    placed = durable(pooled.join(whole, "pool").withColumn("class", class_of))
    classes = placed.groupBy("pool", "class").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.max("large").alias("large"))
    classes = compact(classes.select("pool", "class", "k", "total", "large", F.when(F.col("large"), F.ceil(F.col("total") / task_tokens)).otherwise(1).cast("long").alias("slices")))
    share = lambda salt, parts: F.pmod(F.xxhash64("nid", F.lit(salt)), parts)
    rows = placed.drop("large").join(small_side(classes, broadcast_rows), ["pool", "class"]).withColumn("slice", share(1, F.col("slices")))
    rows = durable(rows.join(sets, "node").select("node", "nid", "n", "own", "pool", "class", "slice", "large", "k", "total"))

    def joined(part: pa.Table) -> pa.Table:
        found = {}
        for node, label, asked, own in zip(*(part.column(c) for c in ("node", "label", "asked")), part.column("own"), strict=True):
            held = found.get(node.as_py())
            found[node.as_py()] = (label.as_py(), asked.as_py() or bool(held and held[1]), held[2] if held else own.values.to_numpy().view(np.uint64))
        links = forest(list(found), [x[2] for x in found.values()], [x[0] for x in found.values()], [x[1] for x in found.values()], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.string()), "b": pa.array([x for _, x in links], pa.string())})

    by = ["pool", "class", "slice", "other_class", "other_slice"]
    none = [F.lit(-1).cast("long").alias("other_class"), F.lit(-1).cast("long").alias("other_slice")]
    own = rows.select("pool", "class", "slice", *none, "node", F.col("node").alias("label"), F.lit(True).alias("asked"), "own")
    split = classes.where("large").select("pool", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    large = not split.isEmpty()
    if large:
        chosen = F.least(F.lit(leaders), F.ceil(task_tokens * F.col("k") / (2 * F.col("total"))))
        heads = rows.where(F.col("large") & (share(2, F.col("k")) < chosen)).select("pool", F.explode(F.array("class", F.col("class") + 1)).alias("class"), "node", "own")
        own = own.unionByName(heads.join(split, ["pool", "class"]).select("pool", "class", "slice", *none, "node", F.col("node").alias("label"), F.lit(True).alias("asked"), "own"))
    edges = durable(own.groupBy(*by).applyInArrow(joined, "a string, b string"))
    roots = connected(edges)
    if large:
        at = small_side(compact(roots.withColumnRenamed("node", "at")), broadcast_rows)  # with a broadcast no set moves again before its groups
        known = rows.where("large").join(at, F.col("node") == F.col("at"), "left").select("pool", "class", "slice", "node", "nid", "n", "own", F.coalesce("root", "node").alias("label"))
        sizes = known.groupBy("pool", "label").agg(F.count("*").alias("k")).groupBy("pool").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
        rest = known.join(small_side(compact(sizes), broadcast_rows), "pool").where("label <> main").drop("main")
        blocks = compact(rest.groupBy("pool", "class").agg(F.ceil(F.sum("n") / task_tokens).cast("long").alias("blocks")))
        rest = rest.drop("slice").join(small_side(blocks, broadcast_rows), ["pool", "class"]).select("pool", F.col("class").alias("other_class"), share(3, F.col("blocks")).alias("other_slice"), "node", "label", "own")
        meet = rest.select("pool", "other_class", "other_slice").distinct().withColumn("class", F.explode(F.array(*[F.col("other_class") + i for i in (-1, 0, 1)])))
        meet = small_side(compact(meet.join(split, ["pool", "class"])), broadcast_rows)
        asked = rest.join(meet, ["pool", "other_class", "other_slice"]).withColumn("asked", F.lit(True))
        held = known.join(meet, ["pool", "class", "slice"]).withColumn("asked", F.lit(False))
        columns = [*by, "node", "label", "asked", "own"]
        more = asked.select(*columns).unionByName(held.select(*columns)).groupBy(*by).applyInArrow(joined, "a string, b string")
        roots = connected(durable(edges.unionByName(more)))
    return roots


def components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, sample_texts: int = 20_000, most_common: int = 500_000,
    task_tokens: int = 2_000_000, leaders: int = 512, broadcast_rows: int = 200_000, filter_bits: int = 1 << 28,
) -> DataFrame:
    """doc_id, n_shingles (distinct n-grams), component_id (smallest doc_id reachable over links), a row for each row of ``docs``.

    Words are split at white space and A-Z lower-cased; with fewer words than ``size`` the
    whole sequence is one n-gram.  Texts without words (null, blank) have an empty set and
    are linked with nothing, not even with each other.  Texts of any length are taken
    whole; repeated rows and equal sets are linked; a null doc_id never names a component
    unless all of its component's are null.  Other columns, whatever their names, are not
    read.  An empty table gives no rows.  N-grams are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    source = docs.select(name(key).alias("doc_id"), name(text).cast("string").alias("text"))
    source = source.withColumn("copy", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    order = spark.sparkContext.broadcast(common_ngrams(source.where("text is not null"), size, sample_texts, most_common))

    def digest(own: np.ndarray) -> bytes:
        return xxhash.xxh3_128_digest(own.astype("<u8").tobytes())

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = order.value
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for value in batch.column(2):
                own = shingle_hashes(value.as_py(), size)
                at = np.minimum(np.searchsorted(tokens, own), max(len(tokens) - 1, 0))
                weight = np.where(tokens[at] == own, counts[at], 0) if len(tokens) else np.zeros(len(own), int)
                nodes.append(digest(own))
                sizes.append(len(own))
                prefixes.append(own[np.lexsort((own, weight))][: prefix_size(len(own), percent)] if len(own) else own)
            ids = np.frombuffer(b"".join(nodes), np.int64).reshape(-1, 2)[:, 0]
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            columns = [batch.column(0), batch.column(1), pa.array([x.hex() for x in nodes], pa.string()), pa.array(ids), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "node", "nid", "n", "prefix"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(x.as_py(), size) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x).hex() for x in found], pa.string()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "own"])

    fields = {"copy": T.StringType(), "node": T.StringType(), "nid": T.LongType(), "n": T.LongType(), "prefix": T.ArrayType(T.LongType())}
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *(T.StructField(c, t) for c, t in fields.items())])
    prints = durable(source.select("doc_id", "copy", "text").mapInArrow(signed, schema))
    needed = least_shared(F.ceil(percent * F.col("n") / 100).cast("long"), percent)  # with the smallest set that can match

    # Sets that share enough of their prefix with others: first as a bitmap of fixed size knows it, which lets some more
    # through (all of them, where it is full) and sends no set anywhere, then exactly; what leaves may leave others alone.
    places = prints.select(F.explode("prefix").alias("token")).select(F.col("token").bitwiseAND(F.lit(filter_bits - 1)).cast("int").alias("place"))
    shared = places.groupBy("place").agg(F.count("*").alias("c")).where("c > 1")
    bits = spark.sparkContext.broadcast(bitmap_of(shared.select(F.col("place").cast("long").alias("place")), filter_bits))

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, needed = batch.column(3), batch.column(5).to_numpy()
            ends, flat = prefix.offsets.to_numpy(), prefix.values.to_numpy().view(np.uint64)
            held = np.cumsum(np.r_[0, in_bitmap(bits.value, flat)])
            yield batch.filter(pa.array(held[ends[1:]] - held[ends[:-1]] >= needed))

    likely = prints.where("n > 0").select("node", "nid", "n", "prefix", "copy", needed.alias("needed"))
    likely = likely.mapInArrow(sharing, likely.schema)
    nodes = likely.groupBy("node").agg(F.first("nid").alias("nid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("copy").alias("copy"))
    before = None
    while True:
        tokens = nodes.select("nid", F.explode("prefix").alias("token"))
        shared = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        enough = tokens.join(shared, "token").groupBy("nid").agg(F.count("*").alias("c"))
        nodes = durable(nodes.join(enough.withColumnRenamed("nid", "id"), (F.col("nid") == F.col("id")) & (F.col("c") >= needed)).select("node", "nid", "n", "prefix", "copy"))
        left = nodes.count()
        if not left or (before is not None and left > 0.9 * before):
            break
        before = left

    keys = F.col("prefix")
    if percent >= NEIGHBOURS:
        keys = F.transform(F.slice(keys, F.lit(1), F.size(keys) - 1), lambda x, i: F.xxhash64(x, F.get("prefix", i + 1)))
    pooled = pools_of(nodes.select("node", "nid", "n", "copy"), hub_pairs(nodes.select("nid", F.explode(keys).alias("key")), "key"))
    wanted = compact(pooled.select(F.col("copy").alias("want")).distinct())
    texts = source.join(small_side(wanted, broadcast_rows), F.col("copy") == F.col("want"), "left_semi").select("text")
    sets = texts.mapInArrow(sets_of, "node string, own array<bigint>").dropDuplicates(["node"])
    roots = pool_roots(pooled, sets, percent, task_tokens=task_tokens, leaders=leaders, broadcast_rows=broadcast_rows)

    named = prints.select("doc_id", F.col("n").alias("n_shingles"), "node").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("least_id"))
    return named.join(names, "root").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))
