"""Scoring documents with a recurrent language model and with smoothed counts, learnt from the training split.

Counts cover all training documents. The most frequent words, a bounded dictionary, travel to the
workers; every other word of a document meets its count in a join, so base scores are exact. Every text
is split twice: to count, and to stage the ids of its tokens, from which the model learns and scores. The
recurrent model (``gru``) is trained by rounds of local descent whose results are averaged; each chunk of
every training document is read once over the rounds. Words outside its short list share one class, inside which they have their
smoothed share of the counts: the score is the probability of the complete text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import gru
from rinkspark.llm.common import shared_value, slices, staged, text_of, words

#: Bounds of what travels: words of the dictionary, their longest length in bytes, the short list.
DICTIONARY, LONGEST, SHORT = 200_000, 40, 1024
#: Tokens of a training chunk; one chunk in so many is used (1: all); averaging rounds; chunks read side by side,
#: at least and at most: a trainer makes at least ``STEPS`` batches of its chunks before it widens them.
CHUNK, STRIDE, ROUNDS, LANES, WIDEST, STEPS = 64, 1, 2, 32, 512, 256
#: Trainers at most, and the chunks that one should have at least.
TRAINERS, SHARE = 32, 8192
#: Parameters are averaged on the workers, in blocks of so many.
BLOCK = 4096
#: The end of a text. Words are never empty.
END = ""


def held_out(id_col: str, modulus: int, rest: int) -> F.Column:
    """A NULL id belongs to the training split."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def word_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """``token, n`` over all texts, ends included; each task sums what it has seen before it shuffles."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            tokens = pa.array(seen.keys(), pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([tokens, pa.array(seen.values(), pa.int64())], ["token", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = words(text)
                for at in range(0, len(found), most):
                    seen.update(found[at : at + most])
                    if len(seen) > most:
                        yield flush()
            seen[b""] += batch.num_rows
        if seen:
            yield flush()

    return texts.mapInArrow(counted, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words above a count, the lowest step of a logarithmic scale that leaves ``most`` at most.

    Found from the number of words per step, a few hundred figures; no task gathers all candidates.
    """
    stepped = counts.withColumn("step", F.floor(F.log2("n") * 8))
    held, lowest = 0, None
    for step, n in sorted(map(tuple, stepped.groupBy("step").count().collect()), reverse=True):
        held += n
        if held > most:
            break
        lowest = step
    return (stepped.filter(F.col("step") >= lowest) if lowest is not None else stepped.limit(0)).drop("step")


class Lexicon:
    """Known words with their counts; the first ``short`` of them, by falling count, have ids of their own."""

    def __init__(self, tokens: list[str], counts: np.ndarray, short: int) -> None:
        self.place = {t.encode(): k for k, t in enumerate(tokens)}
        self.counts = np.append(counts, 0).astype(np.int64)
        self.short = min(short, len(tokens))
        self.other = max(1, -(-self.short // gru.WITHIN)) * gru.WITHIN
        self.end = self.place.get(b"", -1)

    def read(self, text: str) -> tuple[list[bytes], np.ndarray]:
        """Words, and the place of each and of the end; -1 is not in the dictionary."""
        found = words(text)
        places = np.full(len(found) + 1, self.end, np.int64)
        places[:-1] = np.fromiter(map(self.place.get, found, repeat(-1)), np.int64, len(found))
        return found, places

    def ids(self, places: np.ndarray) -> np.ndarray:
        return np.where((places >= 0) & (places < self.short), places, self.other)


def averaged(sent: pa.Table) -> pa.Table:
    """One block of all trainers' parameters, weighted by the tokens that each has seen."""
    sent = sent.sort_by("trainer")
    values = [np.frombuffer(b, np.float32) for b in sent["p"].to_pylist()]
    mean = np.average(values, axis=0, weights=sent["n"].to_numpy().astype(float)).astype(np.float32)
    return pa.table({"block": sent["block"][:1], "p": pa.array([mean.tobytes()], pa.binary())})


def trained(texts: DataFrame, short: int, start: int, stride: int) -> gru.Params:
    """Parameters after ``ROUNDS`` averagings; each round reads its own share of the chunks.

    ``texts``: ``ids, h`` (two bytes a token; a hash of the row, to pick the chunk). Trainers are a fixed number;
    their parameters are averaged on the workers, so the driver holds one set whatever their number.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rounds, deal = [], [], []
            for ids, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunks = -(-len(ids) // (2 * CHUNK))
                for k in range(h % stride, chunks + stride - 1 if chunks < stride else chunks, stride):
                    if k < chunks:
                        out.append(ids[k * 2 * CHUNK : (k + 1) * 2 * CHUNK])
                        rounds.append((h // stride + k) % ROUNDS)
                        deal.append(h + k)
            columns = [pa.array(out, pa.binary()), pa.array(rounds, pa.int32()), pa.array(deal, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "round", "deal"])

    chunks = staged(texts.mapInArrow(cut, "ids binary, round int, deal bigint"), "scoring-chunks")
    found = chunks.count()
    trainers = max(1, min(TRAINERS, found // SHARE))
    lanes = max(LANES, min(WIDEST, found // (ROUNDS * trainers * STEPS)))
    params = gru.fresh(short)
    for k in range(ROUNDS):
        sent = shared_value(texts.sparkSession, params)

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(sent.value, start)
            for batch in batches:
                own = [np.frombuffer(b, "<u2").astype(np.int64) for b in batch.column(0).to_pylist()]
                for at in range(0, len(own), lanes):
                    trainer.batch(own[at : at + lanes])
            if trainer.seen:
                flat = np.concatenate([trainer.p[n].ravel() for n in sorted(trainer.p)])
                blocks = [flat[at].tobytes() for at in slices(len(flat), BLOCK)]
                own, n = (np.full(len(blocks), x) for x in (TaskContext.get().partitionId(), trainer.seen))
                columns = [pa.array(range(len(blocks)), pa.int32()), pa.array(own, pa.int32()), pa.array(blocks, pa.binary()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "trainer", "p", "n"])

        dealt = chunks.filter(F.col("round") == k).select("ids", "deal").repartition(trainers, F.xxhash64("deal", "ids"))
        sets = dealt.mapInArrow(descend, "block int, trainer int, p binary, n bigint")
        got = sets.groupBy("block").applyInArrow(averaged, "block int, p binary").collect()  # one set of parameters
        if got:
            flat = np.concatenate([np.frombuffer(r.p, np.float32) for r in sorted(got, key=lambda r: r.block)])
            at = 0
            for name in sorted(params):
                size = params[name].size
                params[name] = flat[at : at + size].reshape(params[name].shape)
                at += size
    return params


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    rest: int = 2,
    dictionary: int = DICTIONARY,
    short: int = SHORT,
    stride: int = STRIDE,
) -> DataFrame:
    """One row per document: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The training split: rows whose crc32 of the id as text does not leave ``rest`` by ``modulus``.
    ``base_score`` sums log10((c + 1) / (N + V + 1)); ``score`` is the recurrent model's log10
    probability of the whole text with its end. NULL and empty texts are one end. NULL ids train.
    Repeated rows count, and are scored, each time. Without training documents the counts are all
    zero and the model is untrained. An empty table gives no rows. Runs jobs when called.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), held_out(id_col, modulus, rest).alias("held_out"), text_of(text_col).alias("text"))
    train = plain.filter(~F.col("held_out"))
    counts = staged(word_counts(train.select("text")), "scoring-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = total or 0, distinct or 0
    # The end is always in the dictionary: texts cannot hold it, so it cannot be looked up later.
    end, word = counts.filter(F.col("token") == END), counts.filter((F.col("token") != END) & (F.octet_length("token") <= LONGEST))
    top = frequent(word, dictionary).union(end).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    lex = Lexicon(top["token"].to_pylist(), top["n"].to_numpy(), short)
    listed = int(lex.counts[: lex.short].sum())
    lexicon = shared_value(spark, lex)
    start = lex.end if 0 <= lex.end < lex.short else lex.other
    others = np.log10(max(total - listed + distinct - lex.short + 1, 1))  # mass of the words outside the short list

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        logs = np.log10(lex.counts + 1.0)
        for batch in batches:
            sizes, known, base, extra, rare, ids = [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                found, places = lex.read(text)
                unlisted = (places < 0) | (places >= lex.short)
                missing = np.flatnonzero(places < 0)
                if len(missing) and missing[-1] == len(found):  # no training document: the end is not known
                    missing = missing[:-1]
                rare.append([found[k].decode() for k in missing])
                sizes.append(len(places))
                known.append(int((places >= 0).sum()))
                base.append(float(logs[places].sum()))
                extra.append(float(logs[places[unlisted]].sum() - others * unlisted.sum()))
                ids.append(lex.ids(places).astype("<u2").tobytes())
            columns = [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(extra, pa.float64())]
            columns += [pa.array(rare, pa.list_(pa.string())), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *columns], ["id", "held_out", "h", "n_tokens", "known", "base", "extra", "rare", "ids"]
            )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = params.value
        for batch in batches:
            ids = [np.frombuffer(b, "<u2").astype(np.int64) for b in batch.column(1).to_pylist()]
            model = gru.score(p, ids, start) / np.log(10) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model, pa.float64()), *batch.columns[3:]], names)

    kind = docs.schema[id_col].dataType.simpleString()
    hashed = plain.select("id", "held_out", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)).alias("h"), "text")
    parts = hashed.mapInArrow(
        read,
        f"id {kind}, held_out boolean, h bigint, n_tokens bigint, known bigint, base double, extra double, rare array<string>, ids binary",
    )
    parts = staged(parts.select(F.monotonically_increasing_id().alias("row"), "*"), "scoring-parts")
    params = shared_value(spark, trained(parts.filter(~F.col("held_out")).select("ids", "h"), lex.short, start, stride))
    names = ["row", "model", "id", "held_out", "n_tokens", "known", "base"]
    scores = parts.select("row", "ids", "extra", *names[2:]).mapInArrow(
        scored, f"row bigint, model double, id {kind}, held_out boolean, n_tokens bigint, known bigint, base double"
    )
    scores = staged(scores, "scoring-scores")
    rare = parts.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    met = rare.join(counts, "token").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("added")
    )
    whole = scores.join(met, "row", "left")
    added = F.coalesce("added", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + added - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + added).alias("score"),
    )
