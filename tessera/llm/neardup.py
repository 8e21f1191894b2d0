"""Near-duplicates by bottom-k sketches of one hash function.

1. A document's set is hashed once; equal sets form a class with one representative (copies never meet as pairs).
2. The k smallest hashes of a set are its sketch. Inverted lists of the sketches' values generate overlaps. Two
   similar sets share at least `shared_values(...)` of their sketch values, so each set is listed only under its rarest
   ones: what a passage puts into thousands of sets stays out unless it makes up much of the set.
3. Of every list the most central member is compared with all others; what that leaves in more than one
   component is compared across components, short lists by a join, long ones in blocks of bounded size that give out
   only pairs that pass the estimate.
4. The union's sketch estimates the similarity and filters; the Jaccard similarity on full sets decides.
5. Links become components by label propagation with pointer jumping.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, read, small_batches

#: Distinct words of which a task keeps the hash.
CACHE_WORDS = 200_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Near:
    """words: of a shingle; percent: least similarity; k: values of a sketch; miss: chance, at most, that a pair of just
    that similarity shares too few sketch values to be found; list_rows: length from which a list is
    compared in blocks; wide_k: values of the sketches that are compared there; block_rows: rows of a block."""

    words: int = 5
    percent: int = 75
    k: int = 64
    miss: float = 1e-9
    wide_k: int = 512
    list_rows: int = 48
    block_rows: int = 2048


def shared_values(p: Near) -> int:
    """The most values m such that a pair of the least similarity shares fewer than m of the union's k with chance up to `miss`."""
    j, total = p.percent / 100, 0.0
    for m in range(p.k + 1):
        total += math.comb(p.k, m) * j**m * (1 - j) ** (p.k - m)
        if total > p.miss:
            return max(1, m)
    return p.k


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads hashes evenly, so that the smallest are a random draw."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; of the whole sequence if it is shorter."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(h))
    rolled = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = rolled * MULTIPLIER + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(rolled).view(np.int64))


def fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def shingled(docs: DataFrame, p: Near, keep: int | None) -> DataFrame:
    """id, n (size of the set), node (fingerprint of the set) and the `keep` smallest hashes, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(v.as_py(), p.words, known) for v in batch.column(1).slice(at, 500)]
                kept = [s[:keep] for s in sets]
                ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 500), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), lists], names=["id", "n", "node", "hashes"]
                )

    return small_batches(docs.select("id", "text")).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, node binary, hashes array<long>")


def similar_sizes(a: str, b: str, p: Near) -> Column:
    return (100 * F.least(a, b) >= p.percent * F.greatest(a, b)) & (F.col(a) > 0)


def enough(a: Column, b: Column, p: Near, least: int) -> Column:
    """Whether the union's sketch holds so many shared values that the pair may be similar."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, p.k)
    shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
    # a union that fits into its sketch gives the similarity itself
    return F.when(F.size(union) < p.k, 100 * shared >= p.percent * F.size(union)).otherwise(shared >= least)


def estimated(pairs: DataFrame, sketches: DataFrame, p: Near, least: int) -> DataFrame:
    a = sketches.select(F.col("node").alias("a"), F.col("hashes").alias("a_hashes"))
    b = sketches.select(F.col("node").alias("b"), F.col("hashes").alias("b_hashes"))
    return pairs.join(a, "a").join(b, "b").where(enough(F.col("a_hashes"), F.col("b_hashes"), p, least)).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: Near) -> DataFrame:
    """The pairs whose full sets are similar; sets are made again, for the documents in question only."""
    pairs = materialize(pairs, "neardup-candidates")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(classes.select("node", "id"), "node").select("id")
    sets = shingled(docs.join(wanted, "id", "left_semi"), p, None).select("node", F.col("hashes").alias("s"))
    sets = materialize(sets.join(nodes, "node").dropDuplicates(["node"]), "neardup-sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"{x}_s")) for x in "ab")
    shared = F.size(F.array_intersect("a_s", "b_s"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", shared.alias("shared"), (F.size("a_s") + F.size("b_s") - F.size(F.array_intersect("a_s", "b_s"))).alias("union"))
    return materialize(both.where(100 * F.col("shared") >= p.percent * F.col("union")).select("a", "b"), "neardup-links")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links reach, for every node with a link."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "components-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "components-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label").union(labels)
        least = near.groupBy("node").agg(F.min("label").alias("via"))
        jump = labels.select(F.col("node").alias("via"), "label")
        # a label is itself a node, so its own label is one jump further
        new = materialize(least.join(jump, "via").select("node", F.least("via", "label").alias("label")), "components-labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the components after further links, which only join what `labels` (node, label) has found: labels stand for their components."""
    lifted = links.select("a", "b")
    for side in "ab":
        of = labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        lifted = lifted.join(of, side, "left")
    higher = components(lifted.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    up = higher.select(F.col("node").alias("label"), F.col("label").alias("higher"))
    known = labels.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
    return materialize(known.unionByName(higher.join(labels, "node", "left_anti")), "components-merged")


def listed(classes: DataFrame, p: Near, least: int) -> DataFrame:
    """node, n, weight and the sketch values under which the set is listed, the rarest ones that suffice."""
    values = classes.select("node", "n", F.explode("hashes").alias("value"))
    # as a table of its own, so that Spark can split the rows of a value that very many sets share over several tasks of the join
    common = materialize(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "neardup-values")
    held = F.least("n", F.lit(p.k))
    # sets so small that a partner's sketch is its whole set must share their percentage of it
    needed = F.when(F.col("n") <= p.k * p.percent // 100, F.ceil(F.col("n") * p.percent / 100)).otherwise(F.lit(least))
    found = values.join(common, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("weight"))
    places = held - needed + 1 - (held - F.size("v"))  # values that no other set has come first
    return found.where(places > 0).select("node", "n", "weight", F.slice("v", F.lit(1), places.cast("int")).alias("v"))


def across(lists: DataFrame, classes: DataFrame, docs: DataFrame, p: Near, least: int) -> DataFrame:
    """Links between different components within the lists (value, node, n, label, earlier)."""
    mixed_lists = lists.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("value", "rows")
    mixed_lists = materialize(mixed_lists, "neardup-mixed")
    members = materialize(lists.join(mixed_lists, "value"), "neardup-lists")
    short = members.where(F.col("rows") <= p.list_rows).select("value", "node", "n", "label")
    a = short.select("value", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("label").alias("a_label"))
    b = short.select("value", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("label").alias("b_label"))
    met = a.join(b, "value").where((F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label")) & similar_sizes("a_n", "b_n", p))
    pairs = estimated(met.select("a", "b").distinct(), classes, p, least)
    long = members.where(F.col("rows") > p.list_rows)
    if not long.limit(1).count():
        return verified(pairs, classes, docs, p)
    nodes = long.select("node").distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("id")
    wide = shingled(docs.join(wanted, "id", "left_semi"), p, p.wide_k).select("node", "hashes").dropDuplicates(["node"])
    found = materialize(blockwise(long.join(wide, "node"), p), "neardup-blocks")
    return verified(pairs.union(found.where("NOT exact").select("a", "b")).distinct(), classes, docs, p).union(found.where("exact").select("a", "b"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each list on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = (np.concatenate([*map(np.asarray, x), np.zeros(0, np.int64)]) for x in (left, right))
    common = np.intersect1d(a, b)
    a_row, b_row = (np.repeat(np.arange(len(x)), [*map(len, x)]) for x in (left, right))
    a_in, b_in = np.isin(a, common), np.isin(b, common)
    a_row, b_row, a_col, b_col = a_row[a_in], b_row[b_in], np.searchsorted(common, a[a_in]), np.searchsorted(common, b[b_in])
    for at in range(0, len(common), 2048):
        sides = []
        for n, row, col in ((len(left), a_row, a_col), (len(right), b_row, b_col)):
            here = (col >= at) & (col < at + 2048)
            side = np.zeros((n, min(2048, len(common) - at)), np.float32)
            side[row[here], col[here] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def blockwise(members: DataFrame, p: Near) -> DataFrame:
    """a, b, exact: from long lists. Each is cut into blocks, and every two blocks meet in one task.

    A pair that stands together in an earlier list too is left to that one. Sets of up to wide_k hashes are compared as they are; such
    links are exact, and only those are given out that join components which the block has not joined. Pairs with a larger set that pass the
    union's estimate are given out for verification.
    """
    least = shared_values(replace(p, k=p.wide_k))
    count = F.ceil(F.col("rows") / F.lit(p.block_rows)).cast("int")
    block = F.pmod(F.xxhash64("node"), count).cast("int")
    met = F.transform(F.sequence(F.lit(0), count - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    rows = members.withColumn("block", block).withColumn("at", F.explode(met)).select("value", "at.i", "at.j", "block", "node", "n", "label", "earlier", "hashes")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        frame = frame.assign(label=pd.factorize(frame["label"])[0])
        left, right = frame[frame["block"] == i], frame[frame["block"] == j]

        def between(column: str, cross) -> np.ndarray:
            return cross(left[column].to_numpy()[:, None], right[column].to_numpy()[None, :])

        todo = between("label", np.not_equal) & (100 * between("n", np.minimum) >= p.percent * between("n", np.maximum))
        if i == j:
            todo &= np.triu(np.ones(todo.shape, bool), 1)
        if todo.any():
            todo &= overlaps(list(left["earlier"]), list(right["earlier"])) == 0
        left, right = left[todo.any(1)], right[todo.any(0)]
        todo = todo[np.ix_(todo.any(1), todo.any(0))]
        if not todo.size:
            return pd.DataFrame({"a": [], "b": [], "exact": []})
        shared = overlaps(list(left["hashes"]), list(right["hashes"]))
        whole = between("n", np.maximum) <= p.wide_k
        similar = todo & whole & (100 * shared >= p.percent * (between("n", np.add) - shared))
        parent = list(range(int(frame["label"].max()) + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out, nodes, labels, hashes = [], (left["node"].to_numpy(), right["node"].to_numpy()), (left["label"].to_numpy(), right["label"].to_numpy()), (list(left["hashes"]), list(right["hashes"]))
        for x, y in zip(*np.nonzero(similar)):
            a, b = root(labels[0][x]), root(labels[1][y])
            if a != b:
                parent[a] = b
                out.append((nodes[0][x], nodes[1][y], True))
        for x, y in zip(*np.nonzero(todo & ~whole & (shared >= least))):
            if root(labels[0][x]) != root(labels[1][y]):
                union = np.union1d(hashes[0][x], hashes[1][y])[: p.wide_k]
                if np.isin(union, hashes[0][x]).astype(int) @ np.isin(union, hashes[1][y]) >= least:
                    out.append((nodes[0][x], nodes[1][y], False))
        return pd.DataFrame([(min(a, b), max(a, b), e) for a, b, e in out], columns=["a", "b", "exact"])

    return rows.groupBy("value", "i", "j").applyInPandas(compare, "a binary, b binary, exact boolean")


def near_duplicates(docs: DataFrame, *, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col`, n_shingles, component_id, kept.

    Links join sets with percent similarity or more; component_id is the smallest id that links reach. A text that is
    null, empty or without words has an empty set and is linked with nothing. A row without id is linked
    with nothing and kept, its component_id is null. Ids are numbers, or structs, which are compared field by field. Equal texts share a component; repeated rows each give a row.
    Other columns are not read.
    """
    p, least = near, shared_values(near)
    number = isinstance(docs.schema[id_col].dataType, (T.IntegralType, T.StringType))
    texts = docs.select((F.col(id_col).cast("long") if number else F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    sets = materialize(shingled(texts, p, p.k), "neardup-sketches")
    usable = sets.where("n > 0 AND id IS NOT NULL")
    classes = usable.groupBy("node").agg(F.min(F.struct("id", "n", "hashes")).alias("m")).select("node", "m.*")
    classes = materialize(classes, "neardup-classes")

    index = materialize(listed(classes, p, least), "neardup-index")
    lists = index.select("node", "n", "weight", F.explode("v.value").alias("value"))
    sketches = classes.join(index.select("node"), "node", "left_semi").select("node", "hashes")
    # the member whose sketch is the most common stands for its list
    centre = lists.groupBy("value").agg(F.max(F.struct("weight", "node", "n")).alias("c")).select("value", F.col("c.node").alias("b"), F.col("c.n").alias("b_n"))
    centre = materialize(centre, "neardup-centres")
    stars = lists.join(centre, "value").where((F.col("node") != F.col("b")) & similar_sizes("n", "b_n", p))
    ordered = stars.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    links = verified(estimated(ordered, sketches, p, least), classes, texts, p)
    labels = components(links)
    labelled = index.join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"), F.posexplode("v.value").alias("at", "value"), F.col("v.value").alias("all"))
    labelled = labelled.select("value", "node", "n", "label", F.slice("all", F.lit(1), F.col("at")).alias("earlier"))
    rest = across(labelled, classes, texts, p, least)
    labels = merged(labels, rest)

    named = classes.select("node", "id").join(labels, "node")
    smallest = named.groupBy("label").agg(F.min("id").alias("component"))
    named = named.join(smallest, "label").select("node", "component")
    of_class = classes.select("node", "id").join(named, "node", "left").select("node", F.coalesce("component", "id").alias("component"))
    # as a table of its own, so that Spark can split the rows of a text with very many copies over several tasks of the join
    of_class = materialize(of_class, "neardup-components")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    found = sets.select("id", "n", F.when(~alone, F.col("node")).alias("node")).join(of_class, "node", "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = {
    "op5_minhash_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
}
