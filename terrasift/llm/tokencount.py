"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies."""

from __future__ import annotations

import os
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import extended, in_batches, resident

#: The pre-tokens of byte-level BPE (fixed pattern): contractions, words, numbers and signs with a space before, white space.
PRE_TOKENS = (r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
              r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class PieceCounter:
    """Pieces per pre-token of one tokenizer file. The last ``kept`` to twice as many distinct pre-tokens are remembered."""

    def __init__(self, spec: str, kept: int = 300_000):
        import json

        import regex
        from tokenizers import Tokenizer

        own = json.loads(spec)
        pre = own.get("pre_tokenizer") or {}
        added = own.get("added_tokens") or []
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or own.get("normalizer"):
            raise ValueError("only byte-level tokenizers without normaliser are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        own["truncation"] = own["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(own))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.split = regex.compile(PRE_TOKENS).findall
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.kept = kept

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Added tokens in the text, and how often each pre-token occurs between them."""
        if self.special is None or not self.special.search(text):
            return 0, Counter(self.split(text))
        parts = self.special.split(text)
        return len(parts) - 1, Counter(chain.from_iterable(map(self.split, parts)))

    def learn(self, tokens) -> None:
        """Count the pieces of the pre-tokens that are not known, each once."""
        if len(self.new) >= self.kept:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for t in tokens:
            if t not in new:
                if t in old:
                    new[t] = old[t]
                else:
                    missing.append(t)
        for at in range(0, len(missing), 10_000):
            some = missing[at : at + 10_000]
            got = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            new.update(zip(some, map(len, got), strict=True))


def counter(spec: str) -> PieceCounter:
    """The counter of a tokenizer, one per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return resident(f"tokens {hash(spec)}", lambda: PieceCounter(spec))


def tokenizer_file(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver and sent to the tasks (1.5 MB; 32 MB is the bound)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if os.path.getsize(path) > 32 << 20:
        raise ValueError("the tokenizer is larger than 32 MB")
    with open(path, encoding="utf-8") as f:
        return f.read()


def counted(docs: DataFrame, spec: str, *, text: str = "text", group: int = 256) -> DataFrame:
    """Add n_tokens: special strings inside a text count as one token each; null and empty texts have none.

    Per group of documents of a task, the distinct pre-tokens that are not known yet are counted once, and the sum over
    a document is the join of its pre-token frequencies with those counts. No ids are kept, nothing is shuffled, and what a
    worker remembers is bounded.
    """
    src = docs.drop("n_tokens")
    shared, at, names = docs.sparkSession.sparkContext.broadcast(spec), src.columns.index(text), src.columns

    def work(batches):
        c = counter(shared.value)
        for b in batches:
            texts, total = b.column(at).to_pylist(), []
            for i in range(0, len(texts), group):
                found = [c.frequencies(t) if t else (0, Counter()) for t in texts[i : i + group]]
                c.learn(set().union(*(f for _, f in found)))
                pieces = c.new
                total += [s + sum(n * pieces[p] for p, n in f.items()) for s, f in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total, pa.int64())], names=[*names, "n_tokens"])

    return in_batches(src, work, extended(src, "n_tokens long"), keeps=True)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = counted(docs, tokenizer_file())
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
