"""How well token models compress texts: n-gram models and the ideal code length under them."""

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions.text import BLANK, strip
from optrace.session import ROW_BY_ROW, kept, ship_package

CONTEXT_MARK = "\x1f"


def tokens_of(text: Column) -> Column:
    """Words between blanks."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"{BLANK}+"))


def ngram_counts(docs: DataFrame, n: int = 2, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep..., context, token, times): every token after the n-1 tokens before it; the text starts with
    the start token. A row per occurrence, times 1: hardly an n-gram comes twice in a text, and sums are
    formed in the tasks that read the texts."""
    keep = ["doc_id"] if keep is None else keep
    if n < 1:
        raise ValueError("n must be at least 1")
    places = [f"_{back}" for back in range(n - 1, -1, -1)]
    before = [F.concat(F.array_repeat(F.lit(K.START_TOKEN), back), F.col("_tokens")).alias(f"_{back}") for back in range(n - 1, 0, -1)]
    rows = docs.select(*keep, tokens_of(F.col(text)).alias("_tokens"))
    rows = rows.select(*keep, F.inline(F.arrays_zip(*before, F.col("_tokens").alias("_0")))).toDF(*keep, *places).filter("_0 IS NOT NULL")
    context = F.concat_ws(CONTEXT_MARK, *places[:-1]) if n > 1 else F.lit("")
    return rows.select(*keep, context.alias("context"), F.col("_0").alias("token"), F.lit(1).cast("bigint").alias("times"))


#: Tokens of a block of texts, which are read and numbered together, and rows that a task hands on at a time.
BLOCK_TOKENS, BATCH_ROWS = 1 << 20, 1 << 17


def _block(keys: list[pa.Array], sizes: list[int], codes: list[np.ndarray], words: list[str]) -> pa.RecordBatch:
    def listed(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = [pa.array([uuid4().hex]), *map(listed, keys), listed(pa.array(sizes, pa.int32())), listed(pa.array(np.concatenate(codes))), listed(pa.array(words, pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["block", *[f"k{i}" for i in range(len(keys))], "sizes", "codes", "words"])


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts (the last column): their tokens by their places in the block's list of words, the
    start token first."""
    for batch in batches:
        *keys, texts = batch.columns
        first, last = 0, len(texts) - 1
        for i, text in enumerate(texts):
            if i == first:
                # A factory that refers to the list itself would keep every block's words in the worker.
                places: defaultdict[str, int] = defaultdict(count().__next__)
                places[K.START_TOKEN]
                total, sizes, codes = 0, [], []  # blanks are those of tokens_of
            words = (text.as_py() or "").split()
            codes.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
            total += len(words)
            if total >= BLOCK_TOKENS or i == last:
                yield _block([k.slice(first, i + 1 - first) for k in keys], sizes, codes, list(places))
                first = i + 1


def _grams_of(ids: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct n-grams and their times, from its words' numbers: for n up to 2 a number whose
    upper half is the word before, else a row of n numbers."""
    before = [np.concatenate([np.full(back, start), ids])[: len(ids)] for back in range(n - 1, 0, -1)]
    if n > 2:
        return np.unique(np.stack([*before, ids], axis=1), axis=0, return_counts=True)
    return np.unique((before[0] << 32 | ids) if before else ids, return_counts=True)


def _count_blocks(keys: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [*[f"k{i}" for i in range(keys)], "gram", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                *own, sizes, codes, numbers = [c[row].values for c in batch.columns]
                numbers, ends = numbers.to_numpy(), np.cumsum(sizes.to_numpy())
                ids, at, found, rows = numbers[codes.to_numpy()], 0, [], 0
                for i, end in enumerate(ends):
                    if end > at:
                        found.append((i, *_grams_of(ids[at:end], numbers[0], n)))
                        rows += len(found[-1][2])
                    at = end
                    if found and (rows >= BATCH_ROWS or i == len(ends) - 1):
                        places = pa.array(np.repeat([x[0] for x in found], [len(x[2]) for x in found]))
                        grams, times = (np.concatenate([x[k] for x in found]) for k in (1, 2))
                        column = pa.array(list(grams), pa.list_(pa.int64())) if n > 2 else pa.array(grams)
                        yield pa.RecordBatch.from_arrays([*[k.take(places) for k in own], column, pa.array(times)], names)
                        found, rows = [], 0

    return run


def numbered_words(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, id): different words and numbers from 0 on without gaps."""
    found = kept(words.select(word).distinct().withColumn("_at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("_at", 33)
    sizes = found.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # A row for each task that made words.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = found.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.select(word, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def coded_counts(docs: DataFrame, n: int = 2, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep..., gram, times): ngram_counts summed up in each row, with one number for context and token
    (an array of them for n over 2), so that what follows moves and compares numbers.

    Texts are split once, in blocks that list their words; the blocks' lists are numbered by a join."""
    keep = ["doc_id"] if keep is None else keep
    if n < 1:
        raise ValueError("n must be at least 1")
    ship_package(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(k).alias(name) for k, name in zip(keep, names)], F.col(text).alias("text"))
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields[:-1]]
    lists = ", ".join(f"{name} array<{kind}>" for name, kind in kinds)
    blocks = kept(rows.mapInArrow(_read_blocks, f"block string, {lists}, sizes array<int>, codes array<int>, words array<string>"), "blocks", ROW_BY_ROW)
    words = blocks.select("block", F.posexplode("words").alias("code", "word"))
    ids = words.join(numbered_words(words), "word")
    ordered = F.array_sort(F.collect_list(F.struct("code", "id")))
    numbers = ids.groupBy("block").agg(F.transform(ordered, lambda x: x["id"]).alias("numbers"))
    gram = "array<bigint>" if n > 2 else "bigint"
    counted = blocks.join(numbers, "block").select(*names, "sizes", "codes", "numbers").mapInArrow(
        _count_blocks(len(keep), n), ", ".join(f"{name} {kind}" for name, kind in kinds) + f", gram {gram}, times bigint"
    )
    return kept(counted.toDF(*keep, "gram", "times"), "ngrams")


def _context(n: int) -> Column:
    """The part of a gram of coded_counts before its token."""
    return F.slice("gram", 1, n - 1) if n > 2 else F.shiftright("gram", 32)


def fit_counts(counts: DataFrame, group: str | None = None) -> DataFrame:
    """(context, token, n, p) from rows of ngram_counts, with a group column in front for one model
    per group."""
    by = [group] if group else []
    # Kept, for the totals are sums over it, and counting is the most of the work.
    counts = kept(counts.groupBy(*by, "context", "token").agg(F.sum("times").alias("n")), "model")
    totals = counts.groupBy(*by, "context").agg(F.sum("n").alias("_total"))
    return counts.join(totals, [*by, "context"]).withColumn("p", F.col("n") / F.col("_total")).drop("_total")


def fit_ngram(docs: DataFrame, n: int = 2, text: str = "text", group: str | None = None) -> DataFrame:
    """The n-gram model of texts, as fit_counts gives it."""
    return fit_counts(ngram_counts(docs, n, text, [group] if group else []), group)


def floor_probs(model: DataFrame, group: str | None = None, floor: float = K.PROBABILITY_FLOOR) -> DataFrame:
    """Probabilities raised to the floor, then summing to one per context again."""
    by = [*([group] if group else []), "context"]
    raised = model.withColumn("p", F.greatest(F.col("p"), F.lit(floor)))
    totals = raised.groupBy(*by).agg(F.sum("p").alias("_total"))
    return raised.join(totals, by).withColumn("p", F.col("p") / F.col("_total")).drop("_total")


def _with_ratio(costs: DataFrame, bits: str = "bits", out: str = "ratio") -> DataFrame:
    """What 16 bits per token come to against the code length; no bits, no limit."""
    ratio = F.when(F.col(bits) == 0, float("inf")).otherwise(K.BITS_PER_TOKEN_ID * F.col("num_tokens") / F.col(bits))
    return costs.withColumn(out, ratio)


def price_counts(counts: DataFrame, model: DataFrame, doc_id: str = "doc_id", group: str | None = None) -> DataFrame:
    """(doc_id, num_tokens, bits, ratio) from rows of ngram_counts: ideal code length under the model.
    Tokens the model lacks add no bits."""
    by = [group] if group else []
    cost = F.when(F.col("p") > 0, -F.log2("p") * F.col("times"))
    per_doc = (
        counts.join(model.select(*by, "context", "token", "p"), [*by, "context", "token"], "left")
        .groupBy(doc_id).agg(F.sum("times").alias("num_tokens"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("bits"))
    )
    return _with_ratio(per_doc)


def estimate_ratio(
    docs: DataFrame, model: DataFrame, n: int = 2, text: str = "text", doc_id: str = "doc_id",
    group: str | None = None,
) -> DataFrame:
    """price_counts of texts."""
    return price_counts(ngram_counts(docs, n, text, [doc_id, *([group] if group else [])]), model, doc_id, group)


def own_ratio(docs: DataFrame, n: int = 2, text: str = "text", doc_id: str = "doc_id", group: str | None = None) -> DataFrame:
    """estimate_ratio under the texts' own model: texts are read and counted once."""
    by = [group] if group else []
    counts = coded_counts(docs, n, text, [doc_id, *by])
    model = kept(counts.groupBy(*by, "gram").agg(F.sum("times").alias("n")).withColumn("_context", _context(n)), "model")
    totals = model.groupBy(*by, "_context").agg(F.sum("n").alias("_total"))
    prices = model.join(totals, ["_context", *by]).select(*by, "gram", (-F.log2(F.col("n") / F.col("_total"))).alias("_bits"))
    per_doc = counts.join(prices, ["gram", *by], "left").groupBy(doc_id).agg(
        F.sum("times").alias("num_tokens"), F.coalesce(F.sum(F.col("_bits") * F.col("times")), F.lit(0.0)).alias("bits")
    )
    return _with_ratio(per_doc)


def both_costs(docs: DataFrame, group: str, n: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, num_tokens, base_bits, tuned_bits): code lengths under one model of all texts and under
    one per group. Texts are counted once, the model of all texts is summed up from those of the groups,
    and one pass over the counts prices them under both."""
    counts = coded_counts(docs, n, text, [doc_id, group]).withColumnRenamed(group, "_group")
    # A gram, and a context, has a row per group at most here.
    over = lambda key, count: F.sum(count).over(Window.partitionBy(key))
    models = counts.groupBy("gram", "_group").agg(F.sum("times").alias("n"))
    models = kept(models.withColumn("n_all", over("gram", "n")).withColumn("_context", _context(n)), "models")
    totals = models.groupBy("_context", "_group").agg(F.sum("n").alias("_total"))
    totals = totals.withColumn("_total_all", over("_context", "_total"))

    def same(one: str, two: str, key: str) -> Column:
        return (F.col(f"{one}.{key}") == F.col(f"{two}.{key}")) & F.col(f"{one}._group").eqNullSafe(F.col(f"{two}._group"))

    prices = models.alias("m").join(totals.alias("t"), same("m", "t", "_context")).select(
        "m.gram", "m._group", (-F.log2(F.col("n") / F.col("_total"))).alias("_tuned"), (-F.log2(F.col("n_all") / F.col("_total_all"))).alias("_base")
    )
    return counts.alias("c").join(prices.alias("p"), same("c", "p", "gram")).groupBy(doc_id).agg(
        F.sum("times").alias("num_tokens"),
        F.sum(F.col("times") * F.col("_base")).alias("base_bits"), F.sum(F.col("times") * F.col("_tuned")).alias("tuned_bits"),
    )


def byte_ratio(docs: DataFrame, costs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, original_bytes, compressed_bytes, num_tokens, compression_ratio), with
    compressed bytes the bits rounded up; ratio 0 where nothing is left."""
    sizes = docs.select(doc_id, F.octet_length(text).cast("bigint").alias("original_bytes"))
    rows = sizes.join(costs, doc_id, "left").select(
        doc_id, "original_bytes",
        F.ceil(F.coalesce("bits", F.lit(0.0)) / 8).cast("bigint").alias("compressed_bytes"),
        F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"),
    )
    ratio = F.when(F.col("compressed_bytes") > 0, F.col("original_bytes") / F.col("compressed_bytes")).otherwise(0.0)
    return rows.withColumn("compression_ratio", ratio)


def _preview(text: str) -> Column:
    return F.when(F.char_length(text) > 100, F.concat(F.left(text, F.lit(100)), F.lit("..."))).otherwise(F.col(text))


def _saved() -> Column:
    saved = (F.col("base_bytes") - F.col("tuned_bytes")) / F.col("base_bytes") * 100
    return F.when(F.col("base_bytes") == 0, 0.0).otherwise(saved)


def compare_models(
    docs: DataFrame, base: DataFrame, tuned: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Per text the compressed bytes under two models and the saving in percent of the first."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            doc_id, F.col("compressed_bytes").alias(f"{name}_bytes"),
            F.col("compression_ratio").alias(f"{name}_ratio"),
        )

    return (
        docs.select(doc_id, _preview(text).alias("text_preview"), F.char_length(text).alias("text_length"))
        .join(side(base, "base"), doc_id).join(side(tuned, "tuned"), doc_id)
        .withColumn("improvement_pct", _saved())
    )


def compare_grouped(docs: DataFrame, group: str, n: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """compare_models of one model of all texts and one model per group, from both_costs: texts are
    read twice, once to count and once for their sizes and previews."""
    size = F.octet_length(text).cast("bigint")
    rows = docs.select(doc_id, _preview(text).alias("text_preview"), F.char_length(text).alias("text_length"), size.alias("_size"))
    rows = rows.join(both_costs(docs, group, n, text, doc_id), doc_id, "left")
    for name in ("base", "tuned"):
        rows = rows.withColumn(f"{name}_bytes", F.ceil(F.coalesce(f"{name}_bits", F.lit(0.0)) / 8).cast("bigint"))
        ratio = F.when(F.col(f"{name}_bytes") > 0, F.col("_size") / F.col(f"{name}_bytes")).otherwise(0.0)
        rows = rows.withColumn(f"{name}_ratio", ratio)
    return rows.select(
        doc_id, "text_preview", "text_length", "base_bytes", "base_ratio", "tuned_bytes", "tuned_ratio", _saved().alias("improvement_pct")
    )


def check_length(docs: DataFrame, max_tokens: int = K.MAX_TEXT_TOKENS, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): texts of at most max_tokens tokens, and the others with their
    token count and a reason."""
    counted = docs.withColumn("num_tokens", F.size(tokens_of(F.col(text))))
    reason = F.format_string(f"Input has %d tokens, exceeds max_tokens={max_tokens}", F.col("num_tokens"))
    too_long = F.col("num_tokens") > max_tokens
    return counted.filter(~too_long), counted.filter(too_long).withColumn("reason", reason)


def compression_summary(results: DataFrame, ratio: str = "compression_ratio") -> DataFrame:
    """One row: texts, successes (a ratio exists), mean ratio and totals."""
    good = F.col(ratio) > 0
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("successes"),
        F.avg(F.when(good, F.col(ratio))).alias("avg_ratio"),
        F.sum("original_bytes").alias("original_bytes"),
        F.sum("compressed_bytes").alias("compressed_bytes"),
        F.sum("num_tokens").alias("num_tokens"),
    )
