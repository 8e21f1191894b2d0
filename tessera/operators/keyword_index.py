"""A kept keyword index: postings in blocks with bounds, counts by deltas, pruned top-k.

An index is a set of tables of a store, each in parts, one for each change (a segment):

    documents   key, dl, terms with tf, the segment, and the document's place in a chunk: neighbours with CHUNK postings at most
    postings    a row for a block: BLOCK postings or fewer of a term in a chunk, of documents of one class of length and the best first, with the most that one of them gives; documents are known by their places
    frequencies term, how many documents more or less hold it
    totals      how many documents and terms more or less there are
    dead        key, segment and place of documents that have been replaced or deleted

A change reads the earlier rows of its own documents only and writes parts of its own; nothing that is there is written again until `compact`. Chunks are dealt out and turned into blocks where their documents are read: of the
postings nothing is shuffled.

A search first adds up a query's rarest terms and scores the few best documents whole; the k-th best of these scores is one that the k best documents reach at least. What a term can give at most is known for each class of
length. Terms that together cannot reach that score in a class make no document of it a hit by themselves, and a document with a posting in a block whose bound, with the most that the query's other
terms give in its class, stays below it is no hit either. A block is opened if one of the queries needs it. Opened blocks come together by chunk, where the scores of its documents are added up for all queries, and only documents that may be among
a query's best leave it; those are scored whole by the terms kept with them.
Results are those of `search.bm25`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import search as plain
from tessera.operators.tables import ITEM_KEY, repeated_keys
from tessera.sources.shared import BROADCAST_ROWS, few, materialize, small_batches, spread_out
from tessera.sources.versioned import Transaction, VersionedStore

#: Postings of a block and of a chunk at most, buckets of terms (parts are sorted by them, so a scan skips those that nobody asks for), postings of a query's rarest terms that the first look adds up, how many times k documents are then
#: scored whole, relative slack of the bounds, and places of dead documents up to which they go to every task.
BLOCK, CHUNK, BUCKETS, FIRST_LOOK, FIRST_DOCS, SLACK, DEAD = 128, 1 << 20, 32, 4096, 4, 1e-9, 4_000_000
#: Products, and scores (documents times queries), that a task adds up at once.
PRODUCTS, SCORES = 1 << 20, 1 << 19
#: Share of the score to be reached that closed terms may add: what they may add, every document that is found has to be given.
SPARE = 0.1
PARTS = ("documents", "postings", "frequencies", "totals", "dead")
KEY = list(ITEM_KEY)
SPOT = ["segment", "chunk", "place"]
TERMS = "array<struct<term: string, tf: bigint>>"
BLOCKS = "chunk long, term string, class int, n int, most double, mean double, places array<int>, tfs array<int>, dls array<int>"


def bucket_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def gain(tf, dl, avg_dl):
    """Of columns or arrays."""
    return tf * (plain.K1 + 1) / (tf + plain.K1 * (1 - plain.B + plain.B * dl / max(avg_dl, 1e-9)))


def counted_terms(held: pa.ListArray) -> pa.ListArray:
    """Lists of terms as lists of (term, tf)."""
    n = held.value_lengths().to_numpy(zero_copy_only=False)
    words = held.flatten().dictionary_encode()
    codes, size = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
    pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + codes, return_counts=True)
    ends = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * size), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words.dictionary.take(pa.array(pairs % size)), pa.array(tf, pa.int64())], names=["term", "tf"]))


def in_chunks(docs: DataFrame, most: int) -> DataFrame:
    """Documents (key, dl, terms with tf; or key and _listed, the terms one after the other) with their chunk and place in it; chunks have `most` postings, or one document with more."""
    listed = "_listed" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, place, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            terms = counted_terms(last) if listed else last
            dl = last.value_lengths() if listed else batch.column(len(KEY))
            chunks, places = [], []
            for n in terms.value_lengths().to_pylist():
                if place and held + n > most:
                    chunk, place, held = chunk + 1, 0, 0
                chunks.append(chunk)
                places.append(place)
                place, held = place + 1, held + n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEY)], dl.cast(pa.int32()), terms, pa.array(chunks, pa.int64()), pa.array(places, pa.int32())], names=[*KEY, "dl", "terms", "chunk", "place"])

    key = ", ".join(f"{c} string" for c in KEY)
    columns = ["_listed"] if listed else ["dl", "terms"]
    return small_batches(docs.select(*KEY, *columns)).mapInArrow(run, f"{key}, dl int, terms {TERMS}, chunk long, place int")


def inverted(docs: DataFrame, mean: float, block: int) -> DataFrame:
    """The blocks of documents, chunk by chunk. The bound of a block is the most that a posting gives at a mean length of `mean`; at a larger mean it grows by no more than in proportion."""

    def blocks(chunk: int, held: list[tuple]) -> pa.RecordBatch:
        place, dl, n = (np.concatenate([h[k] for h in held]) for k in range(3))
        terms = pa.chunked_array([h[3] for h in held]).combine_chunks()
        place, dl, tf = np.repeat(place, n), np.repeat(dl, n), np.concatenate([h[4] for h in held])
        words = terms.dictionary_encode()
        kind = np.floor(2 * np.log2(dl + 1.0)).astype(np.int32)  # classes of length: two for each doubling
        gains, group = gain(tf, dl, mean), words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 128 + kind
        order = np.lexsort((-gains, group))
        group, gains = group[order], gains[order]
        new = np.flatnonzero(np.diff(group, prepend=-1))
        first = np.repeat(new, np.diff(np.append(new, len(group))))
        starts = np.flatnonzero((np.arange(len(group)) - first) % block == 0)
        ends = pa.array(np.append(starts, len(group)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int32())) for x in (place, tf, dl)]
        size, of = np.diff(np.append(starts, len(group))), group[starts]
        columns = [pa.array(np.full(len(starts), chunk, np.int64)), words.dictionary.take(pa.array(of // 128)), pa.array((of % 128).astype(np.int32)), pa.array(size.astype(np.int32))]
        columns += [pa.array(np.maximum.reduceat(gains, starts)), pa.array(np.full(len(starts), mean)), *lists]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "term", "class", "n", "most", "mean", "places", "tfs", "dls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            chunks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(np.diff(chunks)) + 1, len(chunks)]
            for a, b in zip(cuts, cuts[1:]):
                if held and chunks[a] != at:
                    yield blocks(at, held)
                    held = []
                part = batch.slice(a, b - a)
                pairs = part.column(3).flatten()
                if len(pairs):
                    numbers = [part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)]
                    at = chunks[a]
                    held.append((*numbers, part.column(3).value_lengths().to_numpy(zero_copy_only=False), pairs.field("term"), pairs.field("tf").to_numpy(zero_copy_only=False)))
        if held:
            yield blocks(at, held)

    return small_batches(docs.select("chunk", "place", "dl", "terms")).mapInArrow(run, BLOCKS)


def not_in(docs: DataFrame, dead: DataFrame) -> DataFrame:
    """Documents without the dead ones, which come as a list of places for each chunk."""
    lists = dead.groupBy("segment", "chunk").agg(F.collect_set("place").alias("_dead"))
    found = docs.join(F.broadcast(lists) if few(dead, DEAD) else lists, ["segment", "chunk"], "left")
    return found.where(F.col("_dead").isNull() | ~F.array_contains("_dead", F.col("place"))).drop("_dead")


@dataclass
class Search:
    """What a search looked at: a row for each asked term and block with `read`, whether it was opened, and the hits."""

    blocks: DataFrame
    hits: DataFrame


class KeywordIndex:
    """Items (id, five scope columns, content) of a store's tables under `name`."""

    def __init__(self, store: VersionedStore, name: str, *, block: int = BLOCK, terms: plain.Terms = tx.search_terms):
        self.store, self.name, self.block, self.terms = store, name, block, terms

    # -- changes

    def upsert(self, rows: DataFrame, text: str = "content") -> None:
        """Puts these items in place of those with their keys; a key that stands twice is an error. CommitConflict if another writer changes the index meanwhile."""
        if repeated_keys(rows).limit(1).count():
            raise ValueError("a key stands twice in the batch")
        listed = F.coalesce(self.terms(F.col("_text")), F.array().cast("array<string>"))
        texts = small_batches(spread_out(rows.select(*KEY, F.col(text).alias("_text"))))
        keys = rows.select(*KEY)
        self._change(in_chunks(texts.select(*KEY, listed.alias("_listed")), CHUNK), lambda docs: docs.join(F.broadcast(keys) if few(keys) else keys, KEY, "left_semi"))

    def delete(self, ids: DataFrame, scope: Column) -> None:
        """Takes out the items of a scope range whose id is among `ids`; doing it again changes nothing."""
        self._change(None, lambda docs: docs.where(scope).join(ids.select("id").distinct(), "id", "left_semi"))

    def _change(self, fresh: DataFrame | None, gone) -> None:
        t = self.store.begin()
        segment = f"{1 + max((int(n.rsplit('/', 1)[1]) for n in t.names(f'{self.name}/documents')), default=0):06d}"
        old = None
        if t.names(f"{self.name}/documents"):
            docs = not_in(gone(t.read(f"{self.name}/documents")), t.read(f"{self.name}/dead").select(*SPOT))
            old = materialize(docs.select(*KEY, "dl", "terms", *SPOT), "index-old")
            if fresh is None and not old.limit(1).count():
                return
        self._write(t, segment, fresh, old)
        t.commit()

    def _write(self, t: Transaction, segment: str, fresh: DataFrame | None, old: DataFrame | None) -> None:
        none = self._empty() if fresh is None or old is None else None
        put = lambda part, df: t.write(f"{self.name}/{part}/{segment}", df)
        fresh = put("documents", (none if fresh is None else fresh).select(*KEY, "dl", "terms", F.lit(segment).alias("segment"), "chunk", "place"))
        old = none if old is None else old
        put("dead", old.select(*KEY, *SPOT))
        total = lambda df, sign: df.agg((F.count("*") * sign).alias("docs"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).alias("terms"))
        put("totals", total(fresh, 1).unionByName(total(old, -1)).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")))
        mean = fresh.agg(F.avg("dl").alias("m")).first().m or 1.0  # one row
        blocks = inverted(fresh, max(1.0, mean), self.block).select(F.lit(segment).alias("segment"), "*", bucket_of("term").alias("bucket"))
        blocks = put("postings", blocks.sortWithinPartitions("bucket", "term"))
        held = blocks.select("term", F.col("n").alias("d")).unionByName(old.select(F.explode("terms.term").alias("term"), F.lit(-1).alias("d")))
        deltas = held.groupBy("term").agg(F.sum("d").cast("long").alias("d")).where("d <> 0")
        put("frequencies", deltas.withColumn("bucket", bucket_of("term")).repartition("bucket").sortWithinPartitions("bucket", "term"))

    def _empty(self) -> DataFrame:
        kinds = {**dict.fromkeys(KEY, "string"), "dl": "int", "terms": TERMS, "segment": "string", "chunk": "long", "place": "int"}
        return self.store.spark.range(0).select(*(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))

    def compact(self) -> None:
        """One segment in place of all, without the dead."""
        t = self.store.begin()
        parts = t.names(f"{self.name}/documents")
        if len(parts) < 2:
            return
        segment = f"{1 + max(int(n.rsplit('/', 1)[1]) for n in parts):06d}"
        live = not_in(t.read(f"{self.name}/documents"), t.read(f"{self.name}/dead").select(*SPOT))
        for part in PARTS:
            t.drop(f"{self.name}/{part}")
        self._write(t, segment, in_chunks(live, CHUNK), None)
        t.commit()

    # -- reading

    def documents(self) -> DataFrame:
        """key, dl and terms of the documents that are there."""
        return not_in(self._part("documents"), self._part("dead").select(*SPOT)).select(*KEY, "dl", "terms")

    def _part(self, part: str, version: str | None = None) -> DataFrame:
        return self.store.read(f"{self.name}/{part}", version)

    def search(self, queries: DataFrame, *, top_k: int = plain.TOP_K, where: Column | None = None) -> DataFrame:
        """query_id, the document's key, score, rank, as `search.bm25` gives them for the documents that are there; `where` is over the key's columns."""
        return self.looked_up(queries, top_k=top_k, where=where).hits

    def looked_up(self, queries: DataFrame, *, top_k: int = plain.TOP_K, where: Column | None = None) -> Search:
        """The hits, and which blocks were opened for them. Runs jobs: bounds and the least score are known before blocks are read."""
        plain.checked_sizes(top_k)
        version = self.store.current()
        total = self._part("totals", version).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()  # one row
        n_docs, avg_dl = total.docs or 0, (total.terms or 0) / (total.docs or 1)
        seen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))

        asked = queries.select("query_id", F.explode(self.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        asked = materialize(asked, "index-asked")
        wanted = asked.select("term").distinct()
        small = few(asked)
        buckets = [r.b for r in wanted.select(bucket_of("term").alias("b")).distinct().collect()]  # BUCKETS rows at most
        side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
        df = self._part("frequencies", version).where(F.col("bucket").isin(buckets)).join(side(wanted), "term", "left_semi").groupBy("term").agg(F.sum("d").alias("df"))
        idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(plain.LEAST_IDF))
        weights = materialize(asked.join(side(df), "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")), "index-weights")
        # bounds of the asked terms' blocks: the columns of their heads only are read
        postings = self._part("postings", version).where(F.col("bucket").isin(buckets)).withColumn("most", F.col("most") * F.greatest(F.lit(1.0), avg_dl / F.col("mean")))
        heads = postings.select("term", "class", "segment", "chunk", "n", "most").join(side(wanted), "term", "left_semi")
        classes = materialize(heads.groupBy("term", "class").agg(F.max("most").alias("class_most"), F.sum("n").alias("class_n")), "index-classes")
        sizes = classes.groupBy("term").agg(F.sum("class_n").alias("postings"), F.max("class_most").alias("term_most"))
        before = W.partitionBy("query_id").orderBy(F.desc(F.col("weight") * F.col("term_most")), "term").rowsBetween(W.unboundedPreceding, -1)
        terms = weights.join(side(sizes), "term").select("query_id", "term", "weight", (F.coalesce(F.sum("postings").over(before), F.lit(0)) < FIRST_LOOK).alias("first"))
        terms = terms.join(side(classes), "term").withColumn("most", F.col("weight") * F.col("class_most"))
        terms = materialize(terms.select("query_id", "term", "class", "weight", "most", "first"), "index-terms")
        dead = self._part("dead", version).select(*SPOT)
        docs = self._part("documents", version)
        alive = not_in(docs.select(*KEY, *SPOT).where(seen), dead)
        alive = materialize(alive.groupBy("segment", "chunk").agg(F.collect_list("place").alias("places")), "index-alive")

        def whole(found: DataFrame) -> DataFrame:
            """The scores of documents by all terms that are kept with them."""
            found = materialize(found.select("query_id", *SPOT), "index-found")
            rows = docs.join(F.broadcast(found) if few(found) else found, SPOT).select("query_id", *KEY, "dl", F.explode("terms").alias("t")).select("query_id", *KEY, "dl", "t.*")
            rows = rows.join(side(weights), ["query_id", "term"])
            return rows.groupBy("query_id", *KEY).agg(F.sum(F.col("weight") * gain(F.col("tf"), F.col("dl"), avg_dl)).alias("score"))

        def opened(cuts: DataFrame) -> DataFrame:
            cuts = cuts.groupBy("term", "class").agg(F.min("cut").alias("cut"))
            return postings.join(F.broadcast(cuts) if few(cuts) else cuts, ["term", "class"]).where(F.col("most") >= F.col("cut"))

        # a few documents that are good by the rarest terms, scored by all: their k-th best score is reached by the k best of all
        first = terms.where("first").withColumns({"cut": F.lit(0.0), "spare": F.lit(0.0), "least": F.lit(0.0)})
        of_query = lambda by: W.partitionBy("query_id").orderBy(F.desc(by), *SPOT)
        looked = partial_scores(opened(first), alive, first, FIRST_DOCS * top_k, avg_dl)
        looked = whole(looked.withColumn("at", F.row_number().over(of_query("partial"))).where(F.col("at") <= FIRST_DOCS * top_k))
        least = plain.ranked(looked, top_k, F.desc("score")).where(F.col("rank") == top_k).select("query_id", (F.col("score") * (1 - SLACK)).alias("least"))
        least = materialize(least, "index-least")

        # of the terms of a class, those that bound least come last and are left out, as long as they stay below a share of the score together
        terms = terms.join(F.broadcast(least) if few(least) else least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        of_class = W.partitionBy("query_id", "class")
        rest = F.sum("most").over(of_class.orderBy(F.desc("most"), "term").rowsBetween(W.currentRow, W.unboundedFollowing))
        needed = rest * (1 + SLACK) >= F.col("least") * SPARE
        terms = terms.select("query_id", "term", "class", "weight", "most", "least", needed.alias("needed"), F.sum("most").over(of_class).alias("all"))
        terms = terms.withColumn("spare", F.sum(F.when(F.col("needed"), 0.0).otherwise(F.col("most"))).over(of_class))
        # the bound from which a block is opened for this query
        cut = (F.col("least") / (1 + SLACK) - (F.col("all") - F.col("most"))) / F.col("weight")
        terms = materialize(terms.withColumn("cut", F.when(F.col("needed"), cut)), "index-needed")
        found = partial_scores(opened(terms.where("needed")), alive, terms, top_k, avg_dl)
        hits = plain.ranked(whole(found), top_k, vx.rounded(F.col("score"), 9).desc(), *map(F.col, KEY))
        cuts = terms.groupBy("term", "class").agg(F.min("cut").alias("least_cut"))
        blocks = heads.join(terms.select("query_id", "term", "class"), ["term", "class"]).join(cuts, ["term", "class"])
        return Search(blocks.select("query_id", "term", "class", "segment", "chunk", "n", F.coalesce(F.col("most") >= F.col("least_cut"), F.lit(False)).alias("read")), hits)


def partial_scores(blocks: DataFrame, alive: DataFrame, terms: DataFrame, k: int, avg_dl: float) -> DataFrame:
    """query_id, a document's segment, chunk and place, partial: what the opened blocks give it, for documents that are alive and may be among a query's k best.

    `terms` has query_id, term, class, weight, and of a query's class spare (what closed terms may add at most) and least (what the k best reach). Where the weights of all queries are few enough for every task, they are added up
    chunk by chunk; else blocks and queries are joined on terms.
    """
    weights = terms.select("query_id", "term", "weight").distinct()
    sizes = weights.agg(F.countDistinct("term").alias("t"), F.countDistinct("query_id").alias("q"), F.count("*").alias("n")).first()  # one row
    if not (sizes.n <= BROADCAST_ROWS and sizes.t * sizes.q <= plain.WEIGHTS):
        rows = blocks.select("segment", "chunk", "term", "class", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p"))
        rows = rows.select("segment", "chunk", "term", "class", F.col("p.places").alias("place"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        rows = rows.join(alive.select("segment", "chunk", F.explode("places").alias("place")), SPOT, "left_semi").join(weights, "term")
        sums = rows.groupBy("query_id", *SPOT, "class").agg(F.sum(F.col("weight") * gain(F.col("tf"), F.col("dl"), avg_dl)).alias("partial"))
        bounds = terms.groupBy("query_id", "class").agg(F.max("spare").alias("spare"), F.max("least").alias("least"))
        return sums.join(bounds, ["query_id", "class"]).where((F.col("partial") + F.col("spare")) * (1 + SLACK) >= F.col("least")).select("query_id", *SPOT, "partial")
    held = weights.collect()  # BROADCAST_ROWS at most
    held.sort(key=lambda r: r.term)
    words, ids = sorted({r.term for r in held}), list(dict.fromkeys(r.query_id for r in held))
    column_of = {q: n for n, q in enumerate(ids)}
    # a term's queries and their weights stand from one of `ends` to the next
    ends = np.searchsorted([r.term for r in held], [*words, "\U0010ffff"])
    asks, weight = np.array([column_of[r.query_id] for r in held], np.int64), np.array([r.weight for r in held])
    spare, least = np.zeros((128, len(ids))), np.zeros(len(ids))
    for r in terms.groupBy("query_id", "class").agg(F.max("spare").alias("spare"), F.max("least").alias("least")).collect():  # queries times classes of length
        spare[r["class"], column_of[r.query_id]], least[column_of[r.query_id]] = r.spare, r.least
    id_type = terms.schema["query_id"].dataType
    kind, shared = to_arrow_type(id_type), terms.sparkSession.sparkContext.broadcast((words, ids, ends, asks, weight, spare, least))

    def run(table: pa.Table) -> pa.Table:
        words, ids, ends, asks, weight, spare, least = shared.value
        names, out = ["query_id", *SPOT, "partial"], []
        own = table.filter(pc.is_valid(table["term"]))
        flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        there = flat(table.filter(pc.is_null(table["term"])), "places")
        if own.num_rows and len(there):
            n = pc.list_value_length(own["places"]).to_numpy()
            t = np.repeat(pc.index_in(own["term"], value_set=pa.array(words, pa.string())).to_numpy(), n)
            of_class, place, tf, dl = np.repeat(own["class"].to_numpy(), n), *(flat(own, c) for c in ("places", "tfs", "dls"))
            live = np.zeros(max(place.max(), there.max()) + 1, bool)
            live[there] = True
            order = np.flatnonzero(live[place])
            order = order[np.argsort(place[order], kind="stable")]
            t, of_class, place, gains = t[order], of_class[order], place[order], gain(tf[order], dl[order], avg_dl)
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            stops, uses, best = np.append(starts[1:], len(place)), ends[t + 1] - ends[t], np.zeros((len(ids), k))
            products = np.concatenate([[0], np.cumsum(uses)])
            a = 0
            while a < len(starts):
                # a document at least, else as many as the products and scores allow
                z = int(np.searchsorted(products[stops], products[starts[a]] + PRODUCTS, "right"))
                z = max(a + 1, min(z, a + SCORES // len(ids)))
                rows = slice(starts[a], stops[z - 1])
                n, doc = uses[rows], np.repeat(np.arange(z - a), stops[a:z] - starts[a:z])
                use = np.repeat(ends[t[rows]] - products[rows], n) + np.arange(products[rows.start], products[rows.stop])
                scores = np.bincount(np.repeat(doc, n) * len(ids) + asks[use], weight[use] * np.repeat(gains[rows], n), (z - a) * len(ids)).reshape(z - a, len(ids))
                best = -np.partition(-np.concatenate([best, scores.T], axis=1), k - 1, axis=1)[:, :k]
                reach = (scores + spare[of_class[starts[a:z]]]) * (1 + SLACK) + 2e-9
                row, column = np.nonzero((scores > 0) & (reach >= np.maximum(least, best[:, k - 1])))
                out.append((column, place[starts[a:z]][row], scores[row, column]))
                a = z
        column, at, score = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))
        same = lambda c: pa.repeat(table[c][0], len(at))
        return pa.Table.from_arrays([pa.array(ids, kind).take(pa.array(column)), same("segment"), same("chunk"), pa.array(at, pa.int32()), pa.array(score, pa.float64())], names=names)

    columns = ["segment", "chunk", "term", "class", "places", "tfs", "dls"]
    none = F.array().cast("array<int>")
    marks = alive.select("segment", "chunk", F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("class"), "places", none.alias("tfs"), none.alias("dls"))
    fields = [T.StructField("query_id", id_type), T.StructField("segment", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("partial", T.DoubleType())]
    return blocks.select(*columns).unionByName(marks).groupBy("segment", "chunk").applyInArrow(run, T.StructType(fields))
