"""Lexical lists: words and parts of several weighted columns, scored for batches of queries.

Documents are cut into terms where they are read, and only terms that some query asks for are counted, a document at a time, so no text and no posting is shuffled:
their postings are written once to the shared folder, and read to sum how many documents hold each term, for each term's ``k``-th largest weight, and to score. No query's
``k``-th best score is below such a weight of one of its terms, so a document that can't reach it isn't scored to the end; what is left is exact. The queries' terms
travel with the tasks, in blocks of about ``BLOCK`` terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.wording import match_terms, segment
from .shared import written

#: The columns' weights, and what terms' numbers and texts' sizes weigh.
WEIGHTS = {"title": 10.0, "body": 1.0, "summary": 4.0, "extra": 3.0}
K1, B = 1.2, 0.75
#: Letters with marks and the plain ones that they are searched by.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"
#: Terms of queries that travel with a task, and postings that a task holds at a time.
BLOCK, HELD = 4_000_000, 3_000_000
#: Queries times documents from which a sixteenth of the documents is scored first.
SEEDED = 100_000_000
#: What a bound is lowered by: scores are rounded to six places.
SLACK = 2e-6


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(segment(text)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


#: Rows of documents: their size, and the numbers and weighted counts of the terms that some query asks for.
POSTINGS = "doc_id long, dl long, t array<int>, f array<double>"


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def _postings(docs: np.ndarray, dl: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> pa.RecordBatch:
    keys, back = np.unique(row * max(terms, 1) + term, return_inverse=True)
    f = np.bincount(back, weight, minlength=len(keys))
    sizes = np.bincount(keys // max(terms, 1), minlength=len(docs))
    return pa.record_batch([pa.array(docs, pa.int64()), pa.array(dl, pa.int64()), _lists(sizes, keys % max(terms, 1), pa.int32()), _lists(sizes, f, pa.float64())], ["doc_id", "dl", "t", "f"])


def word_postings(cut: DataFrame, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """The postings of documents cut into words (doc_id, and an array of words for each column), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for b in batches:
            docs = b.column("doc_id").to_numpy()
            sizes = [np.diff(b.column(c).offsets.to_numpy()) for c in weights]
            found = pc.index_in(pa.chunked_array([b.column(c).flatten() for c in weights], pa.string()), value_set=known)  # once a batch: it hashes all terms
            at = pc.fill_null(found, -1).to_numpy()
            row, weight = np.concatenate([np.repeat(np.arange(len(docs)), x) for x in sizes]), np.repeat([*weights.values()], [x.sum() for x in sizes])
            yield _postings(docs, sum(sizes), row[at >= 0], at[at >= 0], weight[at >= 0], len(terms))

    return cut.select("doc_id", *weights).mapInArrow(run, POSTINGS)


def part_postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of terms anywhere in the columns' lower-case texts; the size is the number of three-character parts. Occurrences don't overlap."""
    import ahocorasick

    columns = [c for c in WEIGHTS if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            auto.add_word(t, (k, len(t)))
        if terms:
            auto.make_automaton()
        for b in batches:
            row, term, weight = [], [], []
            for i, texts in enumerate(zip(*(b.column(c).to_pylist() for c in columns), strict=True)):
                for c, text in zip(columns, texts, strict=True):
                    free: dict[int, int] = {}
                    for end, (k, n) in auto.iter(text) if terms and text else ():
                        if end - n + 1 >= free.get(k, 0):
                            free[k] = end + 1
                            row.append(i)
                            term.append(k)
                            weight.append(WEIGHTS[c])
            yield _postings(b.column("doc_id").to_numpy(), b.column("dl").to_numpy(), np.array(row, dtype=np.int64), np.array(term, dtype=np.int64), np.array(weight), len(terms))

    size = sum((F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)) for c in columns), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("dl"), *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns)).mapInArrow(run, POSTINGS)


def numbers(postings: DataFrame, terms: int) -> tuple[int, float, np.ndarray]:
    """Documents, their mean size, and how many hold each term: sums of a task first, one row a term in the driver, which has the queries' terms anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = np.zeros(terms, dtype=np.int64), 0, 0
        for b in batches:
            held += np.bincount(b.column("t").flatten().to_numpy(), minlength=terms)
            n += b.num_rows
            size += int(b.column("dl").to_numpy().sum())
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.concatenate([[-1, -2], some]), pa.int64()), pa.array(np.concatenate([[n, size], held[some]]), pa.int64())], ["t", "n"])

    found = postings.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, c = found.column("t").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(terms)
    df[t[t >= 0]] = c[t >= 0]
    n = int(c[t == -1].sum())
    return n, int(c[t == -2].sum()) / max(n, 1), df


class Held:
    """The postings of a task's next documents, ``HELD`` of them or little more, by term: weights, and the documents' places in ``ids``."""

    def __init__(self, batches: list[pa.RecordBatch], idf: np.ndarray, avgdl: float) -> None:
        joined = lambda c: np.concatenate([b.column(c).to_numpy() for b in batches])
        flat = lambda c: np.concatenate([b.column(c).flatten().to_numpy() for b in batches])
        self.ids, dl, t, f = joined("doc_id"), joined("dl"), flat("t"), flat("f")
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.concatenate([np.diff(b.column("t").offsets.to_numpy()) for b in batches]))
        w = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl[doc] / avgdl))
        order = np.argsort(t, kind="stable")
        self.doc, self.w = doc[order], w[order]
        self.counts = np.bincount(t, minlength=len(idf))
        self.ptr = np.concatenate([[0], np.cumsum(self.counts)])
        some = np.flatnonzero(self.counts)
        self.most = np.zeros(len(idf))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.w, self.ptr[some])
        # Terms that a quarter of the documents hold: weights by place, at most four times the postings.
        frequent = np.flatnonzero(self.counts * 4 > len(self.ids))
        self.row, self.dense = np.full(len(idf), -1), np.zeros((len(frequent), len(self.ids)))
        self.row[frequent] = np.arange(len(frequent))
        for t, row in zip(frequent, self.dense, strict=True):
            row[self.doc[self.ptr[t] : self.ptr[t + 1]]] = self.w[self.ptr[t] : self.ptr[t + 1]]

    def heads(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights): the ``k`` largest weights of each term."""
        t = np.repeat(np.arange(len(self.counts)), self.counts)
        order = np.lexsort((-self.w, t))
        head = np.arange(len(t)) - self.ptr[t] < k  # lexsort keeps the terms' places
        return t[head], self.w[order][head]

    def best(self, term: np.ndarray, starts: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, its documents' places, scores) of each query, whose terms are ``term[starts[i]:starts[i + 1]]``: the ``k`` best here, but none below its ``floor``, which
        rises. Documents are found by the terms whose weights and those of all smaller terms together reach the floor; the smaller terms are added to what still can."""
        reach = np.add.reduceat(self.most[term], starts[:-1])
        ptr, doc, w, acc = self.ptr, self.doc, self.w, np.zeros(len(self.ids))
        for i in np.flatnonzero((reach > 0) & (reach >= floor)):
            ts, low = term[starts[i] : starts[i + 1]], floor[i]
            most = self.most[ts]
            order = np.argsort(most, kind="stable")[np.count_nonzero(most == 0) :]
            ts = ts[order]
            reached = most[order].cumsum()
            cut = int(reached.searchsorted(low))
            lists = [doc[ptr[t] : ptr[t + 1]] for t in ts[cut:]]
            for t, d in zip(ts[cut:], lists, strict=True):
                acc[d] += w[ptr[t] : ptr[t + 1]]
            at = lists[0] if len(lists) == 1 else np.concatenate(lists) if lists else doc[:0]
            at = at[acc[at] + (reached[cut - 1] if cut else 0.0) >= low]
            if len(lists) > 1:
                at = np.unique(at)
            sums = acc[at]
            for d in lists:
                acc[d] = 0.0
            for j in range(cut - 1, -1, -1):
                if not len(at):
                    break
                if (r := self.row[ts[j]]) >= 0:
                    sums += self.dense[r][at]
                else:
                    d = doc[ptr[ts[j]] : ptr[ts[j] + 1]]
                    place = np.minimum(d.searchsorted(at), len(d) - 1)
                    sums += np.where(d[place] == at, w[ptr[ts[j]] : ptr[ts[j] + 1]][place], 0.0)
                if j and len(at) > k:
                    keep = sums + reached[j - 1] >= low
                    at, sums = at[keep], sums[keep]
            sums = np.round(sums, 6)
            keep = sums >= low
            at, sums = at[keep], sums[keep]
            if len(at) > k:
                least = np.partition(sums, len(sums) - k)[len(sums) - k]
                at, sums = at[sums >= least], sums[sums >= least]
                order = np.lexsort((self.ids[at], -sums))[:k]
                at, sums = at[order], sums[order]
            if len(at) == k:
                floor[i] = max(low, sums.min() - SLACK)
            if len(at):
                yield i, at, sums


def held(batches: Iterator[pa.RecordBatch], idf: np.ndarray, avgdl: float) -> Iterator[Held]:
    part, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            b = batch.slice(i, 4096)
            part.append(b)
            n += len(b.column("t").flatten())
            if n >= HELD:
                made, part, n = Held(part, idf, avgdl), [], 0
                yield made
                del made
    if part:
        yield Held(part, idf, avgdl)


def heads(postings: DataFrame, idf: np.ndarray, avgdl: float, k: int) -> np.ndarray:
    """The ``k``-th largest weight of each term over all documents, 0 where fewer hold it: a floor for the ``k``-th best score of each query that asks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in held(batches, idf, avgdl):
            t, w = h.heads(k)
            yield pa.record_batch([pa.array(t, pa.int32()), pa.array(w, pa.float64())], ["t", "w"])

    kth = F.get(F.sort_array(F.collect_list("w"), False), F.lit(k - 1))
    found = postings.mapInArrow(run, "t int, w double").groupBy("t").agg(kth.alias("w")).where("w is not null").toArrow()
    out = np.zeros(len(idf))
    out[found.column("t").to_numpy()] = found.column("w").to_numpy()
    return out


def scored(postings: DataFrame, terms: list[str], asked: DataFrame, k: int, plus: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of each query of ``asked`` (query_id, term) by BM25; ``plus`` keeps the weight of terms that most
    documents hold above 0 by ln(1 + x) instead of a floor."""
    empty = asked.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    if not terms:
        return empty
    postings = written(postings, "postings")
    n, avgdl, df = numbers(postings, len(terms))
    odds = (n - df + 0.5) / (df + 0.5)
    with np.errstate(invalid="ignore", divide="ignore"):
        idf = np.log1p(odds) if plus else np.where(odds > 1, np.log(odds), 1e-6)
    kth = heads(postings, idf, avgdl, k)
    known, found = pa.array(terms, pa.string()), None
    pairs = written(asked.distinct(), "asked")
    blocks = max(1, -(-pairs.count() // BLOCK))
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        query, term = own.column("query_id").to_numpy(), pc.index_in(own.column("term"), value_set=known).to_numpy().astype(np.int32)
        if not len(query):
            continue
        order = np.lexsort((term, query))
        query, term = query[order], term[order]
        ids, starts = np.unique(query, return_index=True)
        floor = np.maximum.reduceat(kth[term], starts) - SLACK
        starts = np.append(starts, len(term))

        if len(ids) * n > SEEDED:  # the best of some documents raise the floors for the others
            some = F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0
            first = written(_top(_best(_dealt(postings.where(some), df.sum() / 16), idf, avgdl, term, starts, ids, floor, k), k), "seed")
            last = first.where(F.col("rank") == k).select("query_id", "score").toArrow()
            at = np.searchsorted(ids, last.column("query_id").to_numpy())
            floor[at] = np.maximum(floor[at], last.column("score").to_numpy() - SLACK)
            one = first.drop("rank").unionByName(_best(_dealt(postings.where(~some), df.sum()), idf, avgdl, term, starts, ids, floor, k))
        else:
            one = _best(_dealt(postings, df.sum()), idf, avgdl, term, starts, ids, floor, k)
        found = one if found is None else found.unionByName(one)
    return empty if found is None else _top(found, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")).cast("int")
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _dealt(postings: DataFrame, n: float) -> DataFrame:
    """Files of ``n`` postings in partitions of about ``HELD``, but in no fewer than run at once: what a query costs a task besides its documents counts once a partition."""
    return postings.coalesce(max(int(n // HELD) + 1, postings.sparkSession.sparkContext.defaultParallelism))


def _best(postings: DataFrame, idf: np.ndarray, avgdl: float, term: np.ndarray, starts: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    floor = floor.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floor.copy()
        for h in held(batches, idf, avgdl):
            out, rows = [], 0
            for x in h.best(term, starts, k, least):
                out.append(x)
                rows += len(x[1])
                if rows >= 100_000:
                    yield _found(out, ids, h.ids)
                    out, rows = [], 0
            if out:
                yield _found(out, ids, h.ids)
            del h  # before the next are made

    return postings.mapInArrow(run, "query_id long, doc_id long, score double")


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]], ids: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    query = np.repeat(ids[[r[0] for r in rows]], [len(r[1]) for r in rows])
    return pa.record_batch([pa.array(query), pa.array(docs[np.concatenate([r[1] for r in rows])]), pa.array(np.concatenate([r[2] for r in rows]))], ["query_id", "doc_id", "score"])


def terms_of(asked: DataFrame) -> list[str]:
    """The distinct terms of the queries."""
    return sorted(asked.select("term").distinct().toArrow().column("term").to_pylist())


def word_list(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The list of ``queries`` (query_id, text) over the words of ``docs``."""
    wanted = F.flatten(F.transform(match_terms(F.col("text"), True), lambda w: F.regexp_extract_all(folded(w), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))))
    asked = queries.select("query_id", F.explode(F.array_distinct(wanted)).alias("term"))
    weights = {c: w for c, w in WEIGHTS.items() if c in docs.columns}
    terms = terms_of(asked)
    cut = docs.select("doc_id", *(words(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in weights))
    return scored(word_postings(cut, weights, terms), terms, asked, k)


def part_list(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The list of ``queries`` over parts of three characters or more of ``docs``; queries without such a term have none."""
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform(match_terms(F.col("text"), False), F.lower))).alias("term"))
    terms = terms_of(asked)
    return scored(part_postings(docs, terms), terms, asked, k)
