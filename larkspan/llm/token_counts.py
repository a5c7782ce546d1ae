"""Token counts through a cache of digests.

A text is known by the SHA-256 digest of its normalised content, a tokenizer by the digest of its file, its library and the library's
version. Counts are stored as Parquet under the tokenizer's digest. A run digests every text, takes from the distinct digests those that the
store does not hold, encodes one text of each, appends the counts to the store, and joins all rows to it. Only texts that have to be
encoded are moved: they are found by digest and by the smallest id among the copies, so copies of one text do not meet in
one task. Digests that at least one row in ``HOT`` holds, ``HOT`` at most, go to all rows by broadcast.

Normalisation is what leaves the count as it is. A byte-level vocabulary sees every byte, so the default only turns null into the empty text;
``normalise`` may do more for a tokenizer that folds case or drops white space itself.

The store only grows: a batch is a folder of its own, written by one job. A job that fails leaves rows that are right, or none; two jobs
that miss the same digest both append it, and reading takes each digest once.

Defined cases: null counts as the empty text, which has 0 bytes and 0 tokens; texts of any length are counted whole; strings of special tokens
inside a text count as the library takes them by default; repeated rows each give a row; a null id stays null; an empty
table gives no rows and appends nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib.metadata import version as library_version

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.bestfit_packing import byte_characters
from larkspan.session import write_table

#: A digest that one row in HOT holds is broadcast; there can be no more than HOT of them.
HOT = 1000
_KEEP_PIECES, _LONG_PIECE = 1_000_000, 100
#: A byte-level split never joins one of these characters with white space behind it, so a text may be cut there.
_SOLID = "!-~À-ɏ"
_PIECE = re.compile("[ \n]*[^ \n]+|[ \n]+")
_LOOSE = re.compile(f"[^{_SOLID} \n][ \n]")
#: Letters that every version of Unicode has, and punctuation of ASCII.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@[-`{-~]*)")
_PIECE_OF_ANY = re.compile(f".+?(?:(?<=[{_SOLID}])(?=[ \n])|\\Z)", re.DOTALL)


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer's file, the same on every machine, and the digest of all that its counts depend on."""

    path: str

    @property
    def library(self) -> str:
        return "sentencepiece" if self.path.endswith(".model") else "tokenizers"

    def digest(self) -> str:
        """Hex digest of the file's bytes, the library and its version."""
        found = hashlib.sha256(f"{self.library} {library_version(self.library)}\n".encode())
        with open(self.path, "rb") as f:
            for part in iter(lambda: f.read(1 << 20), b""):
                found.update(part)
        return found.hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        """What counts the tokens of texts; made on a worker."""
        if self.library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda texts: [len(model.encode(t)) for t in texts]
        return JsonCounter(self.path)


class JsonCounter:
    """Token counts by a vocabulary in JSON. A byte-level tokenizer without normaliser splits a text wherever a visible character comes before a
    space or a line end, so the count of a text is the sum over such pieces, and pieces met before are not encoded again. Any
    other tokenizer encodes each text as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and told.get("normalizer") is None
            and not any(set(t["content"]) & {" ", "\n"} or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told.get("added_tokens", []))
        )
        self.known: dict[str, int] = {}
        self.model, self.shown = self.tokenizer.model, dict(enumerate(byte_characters()))
        self.space = self.shown[32]

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self.encode(texts)
        if len(self.known) > _KEEP_PIECES:
            self.known.clear()
        known = self.known
        split = [(_PIECE_OF_ANY if _LOOSE.search(t) else _PIECE).findall(t) for t in texts]
        new = [p for p in set().union(*split) if p not in known]
        counts = self.pieces(new)
        known.update((p, n) for p, n in counts.items() if len(p) <= _LONG_PIECE)
        long = {p: n for p, n in counts.items() if len(p) > _LONG_PIECE}
        if not long:
            return [sum(map(known.__getitem__, pieces)) for pieces in split]
        return [sum(known[p] if p in known else long[p] for p in pieces) for pieces in split]

    def pieces(self, new: list[str]) -> dict[str, int]:
        """The counts of pieces. A word of plain letters with punctuation behind it is two units of the byte-level split, which
        go to the model by themselves; any other piece goes through the whole tokenizer."""
        counts: dict[str, int] = {}
        rest = []
        for p in new:
            plain = _PLAIN.fullmatch(p) if len(p) <= _LONG_PIECE else None
            if plain:
                counts[p] = sum(map(self.unit, filter(None, plain.groups())))
            else:
                rest.append(p)
        for at in range(0, len(rest), 256):
            counts.update(zip(rest[at : at + 256], self.encode(rest[at : at + 256])))
        return counts

    def unit(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            shown = text.replace(" ", self.space) if text.isascii() else text.encode().decode("latin-1").translate(self.shown)
            n = self.known[text] = len(self.model.tokenize(shown))
        return n


class CountStore:
    """Counts by digest below ``path``, a folder of its own for each tokenizer digest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, vocabulary: str) -> DataFrame:
        """``digest, n_tokens`` with each digest once."""
        schema = "digest binary, n_tokens bigint"
        folder = f"{self.path}/{vocabulary}"
        if not self._there(folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, vocabulary: str) -> None:
        counts.select("digest", "n_tokens").write.parquet(f"{self.path}/{vocabulary}/{uuid.uuid4().hex}")


def encode_missing(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``digest, text`` to ``digest, n_tokens``. Rows of one digest in a task are encoded once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, seen = vocabulary.counter(), set()
        for pdf in batches:
            first = [d not in seen and not seen.add(d) for d in map(bytes, pdf["digest"])]
            pdf = pdf[first]
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                yield pd.DataFrame({"digest": part["digest"], "n_tokens": tokens(list(part["text"]))})

    return texts.select("digest", "text").mapInPandas(count, "digest binary, n_tokens bigint")


def count_tokens(
    docs: DataFrame, path: str, store_path: str, normalise: Callable[[Column], Column] = lambda text: text, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row ``id_column, digest, n_bytes, n_tokens`` for each row of ``docs``: the digest and size of its normalised content, and its tokens by
    the vocabulary at ``path``. Counts come from the store at ``store_path`` and are added to it."""
    vocabulary, store = Vocabulary(path), CountStore(docs.sparkSession, store_path)
    name = vocabulary.digest()
    text = F.coalesce(normalise(F.coalesce(F.col(text_column), F.lit(""))), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    facts = write_table(rows.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
    groups = write_table(facts.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first")), "distinct")
    missing = groups.join(store.read(name), "digest", "left_anti").select("digest", "first").hint("shuffle_hash")
    one = (rows["digest"] == missing["digest"]) & rows["id"].eqNullSafe(missing["first"])
    store.append(encode_missing(rows.join(missing, one, "left_semi"), vocabulary), name)

    counts = store.read(name)
    total = groups.agg(F.sum("copies")).first()[0] or 0
    often = groups.where(F.col("copies") * HOT >= total).select("digest")
    often = write_table(counts.join(F.broadcast(often), "digest").withColumnRenamed("n_tokens", "often"), "often")
    marked = facts.join(F.broadcast(often), "digest", "left")  # HOT rows at most
    rest = marked.where("often is null").drop("often").join(counts, "digest")
    columns = [F.col("id").alias(id_column), "digest", "n_bytes"]
    return marked.where("often is not null").select(*columns, F.col("often").alias("n_tokens")).unionByName(rest.select(*columns, "n_tokens"))
