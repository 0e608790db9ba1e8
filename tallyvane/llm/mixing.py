"""Mixing sources to target weights by systematic sampling.

Sizes are tokens of a public tokenizer. A source's expected copies of each document are its target tokens over
its own tokens, at most `max_repeats`. Documents of a source are numbered densely, in order of size within hashed
sub-groups, the expected copies are prefix-summed along that order, one offset in [0, 1) is added, and a document is
emitted once for each whole number its stretch crosses: copies = floor(o + c(k+1)) - floor(o + ck). Taking the order
by size spreads the copies evenly over sizes, so the realised tokens stay close to the expected ones.

Defined results: null or empty texts have no tokens and are never emitted; documents of sources without a target
are not used; a target without documents reports zero tokens; ties in size are ordered by id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.session import checkpoint, dense_index, spread

TOKENIZER_DIR, MOST_BYTES = "/opt/tokenizers", 64 << 20


def vocabulary(name: str = "byte_bpe_50k.tiktoken", directory: str = TOKENIZER_DIR) -> bytes:
    """A tokenizer's file, read on the driver and shipped with the job, so executors need no copy; at most 64 MB."""
    path = f"{directory}/{name}"
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encoder(name: str = "byte_bpe_50k.tiktoken", data: bytes | None = None):
    """A function from a list of texts to their token counts; the library follows from the file's ending."""
    data = vocabulary(name) if data is None else data
    if name.endswith(".tiktoken"):
        import base64
        import sys

        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        e = tiktoken.Encoding(sys.intern(name), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(t)) for t in texts]
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in sp.encode(list(texts), num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode("utf-8"))
    t.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in t.encode_batch(list(texts), add_special_tokens=False)]


def document_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", name: str = "byte_bpe_50k.tiktoken", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens) of every document; null texts have 0 tokens."""
    made: dict = {}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(name, directory))  # its size is checked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = made.get("f") or made.setdefault("f", encoder(name, shared.value))
        for pdf in batches:
            n = count([t if t is not None else "" for t in pdf["t"]])
            yield pd.DataFrame({"k": pdf["k"], "s": pdf["s"], "n": pd.Series(n, dtype="int64")})

    rows = spread(docs.select(F.col(key).cast("bigint").alias("k"), F.col(source).alias("s"), F.col(text).alias("t")))
    return rows.mapInPandas(run, "k bigint, s string, n bigint").select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("tokens"))


def source_budget(tokens: DataFrame, targets: DataFrame, size: float | None = None) -> DataFrame:
    """Per target source: n_docs, tokens, target_tokens, copies (expected copies a document, capped) and
    reachable. The mix's size is the whole corpus unless `size` is given (in tokens)."""
    # one row a source; kept, as both the sources and their total need it and counting tokens is the costly part
    by = checkpoint(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")))
    all_tokens = by.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")) if size is None else tokens.sparkSession.range(1).select(F.lit(float(size)).alias("all_tokens"))
    t = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").fillna(0, ["tokens", "n_docs"]).join(F.broadcast(all_tokens))  # one row
    need = F.col("target_share") * F.col("all_tokens")
    return t.select(
        "source", "target_share", "max_repeats", "n_docs", "tokens", need.alias("target_tokens"),
        F.when(F.col("tokens") > 0, F.least(need / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("copies"),
        (F.col("tokens") * F.col("max_repeats") >= need).alias("reachable"),
    )


def systematic_mix(tokens: DataFrame, targets: DataFrame, seed: int = 7, size: float | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies): the mix, one row for each document used, at most max_repeats copies."""
    tokens = checkpoint(tokens)
    return _sampled(tokens, source_budget(tokens, targets, size), seed)


def _sampled(tokens: DataFrame, budget: DataFrame, seed: int) -> DataFrame:
    budget = budget.select("source", F.col("copies").alias("c"))
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    numbered = dense_index(tokens.where(F.col("source").isNotNull() & (F.col("tokens") > 0)), ["source"], ["tokens", "doc_id"], "k")
    w = numbered.join(budget, "source").withColumn("o", offset)
    crossed = F.floor(F.col("o") + F.col("c") * (F.col("k") + 1)) - F.floor(F.col("o") + F.col("c") * F.col("k"))
    return w.select("doc_id", "source", "tokens", crossed.cast("bigint").alias("copies")).where("copies > 0")


def short_sources(tokens: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(source, target_tokens, mix_tokens) of the target sources that the sampled mix leaves short of their share of a
    mix as large as the whole corpus: every document with tokens is used `max_repeats` times and the mix still holds
    fewer tokens than the target."""
    tokens = checkpoint(tokens)
    budget = source_budget(tokens, targets)
    mix = _sampled(tokens, budget, seed)
    by = mix.groupBy("source").agg(F.count(F.lit(1)).alias("used"), F.min("copies").alias("least"), F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"))
    full = tokens.where("tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("filled"))
    r = budget.select("source", "max_repeats", "target_tokens").join(by, "source", "left").join(full, "source", "left").fillna(0, ["used", "least", "mix_tokens", "filled"])
    spent = (F.col("used") == F.col("filled")) & ((F.col("least") >= F.col("max_repeats")) | (F.col("filled") == 0))
    return r.where(spent & (F.col("mix_tokens") < F.col("target_tokens"))).select("source", "target_tokens", "mix_tokens")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: docs used, tokens in the mix and the actual share beside the target share."""
    by = mix.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    total = by.agg(F.sum("mix_tokens").alias("all_mix"))
    t = targets.select("source", "target_share").join(by, "source", "left").fillna(0, ["docs", "mix_tokens", "most_copies"]).join(F.broadcast(total))  # one row
    return t.select("source", "target_share", "docs", "mix_tokens", "most_copies", (F.col("mix_tokens") / F.col("all_mix")).alias("actual_share"))
