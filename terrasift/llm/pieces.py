"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

At each position the automaton's output links give every piece that ends there, the longest first, and the best score is
relaxed over them. A unigram model relaxes over all pieces. A byte-pair model admits a piece only after a piece that its
merges leave beside it, so the path that survives is the library's.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import extended, in_batches, resident

SPACE = "▁"


class Codec:
    """Encoder and decoder of one model: identity normaliser, leading space, optional byte fallback."""

    def __init__(self, model: bytes, kind: str | None = None, kept: int = 150_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.normalize("ﬁ  a ") != f"{SPACE}ﬁ{SPACE}{SPACE}a{SPACE}":
            raise ValueError("only models with the identity normaliser and a leading space are supported")
        self.kind = kind or _model_type(model)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.penalty = min((self.score[i] for i in normal), default=0.0) - 10.0
        self.id_of = {self.piece[i]: i for i in normal}
        self.trie = ahocorasick.Automaton()
        for i in normal:
            self.trie.add_word(self.piece[i], (len(self.piece[i]), self.score[i], i))
        if normal:
            self.trie.make_automaton()
        # no piece holds a space after another character, and characters that only stand alone end a stretch too
        inner = set("".join(self.piece[i] for i in normal if len(self.piece[i]) > 1))
        if any(SPACE in self.piece[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece spans a word's end")
        alone = "".join(sorted({chr(c) for c in range(33)} - inner))
        self.stretch = re.compile(f"[{re.escape(alone)}]+|{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+")
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.kept = kept
        self.stays: dict[int | tuple[str, str], bool] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; stretches between spaces are independent, and the last ones seen are remembered."""
        if not text:
            return []
        out: list[int] = []
        new, old = self.new, self.old
        for part in self.stretch.findall(SPACE + text.replace(" ", SPACE)):
            ids = new.get(part)
            if ids is None:
                ids = old.get(part)
                if ids is None:
                    ids = (self._joined(part) if self.kind == "bpe" else None) or self._best(part)
                if len(part) <= 64:
                    if len(new) >= self.kept:
                        self.old = old = new
                        self.new = new = {}
                    new[part] = ids
            out += ids
        return out

    def _joined(self, part: str) -> tuple[int, ...] | None:
        """The path of a byte-pair model where pieces cover the whole stretch, else None: the first piece that may stand there
        is the only one, so scores need not be kept."""
        n = len(part)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        last[0] = 0
        stays = self.stays
        for end, (size, _, i) in self.trie.iter(part):
            to = end + 1
            if last[to] >= 0:
                continue
            start = to - size
            before = last[start]
            if before < 0:
                continue
            if start:
                ok = stays.get(before << 32 | i)
                if ok is None:
                    ok = self._beside((0, before), self.piece[before], i, self.piece[i])
                if not ok:
                    continue
            last[to], begin[to] = i, start
        if last[n] < 0:
            return None
        path = []
        while n:
            path.append(last[n])
            n = begin[n]
        return tuple(path[::-1])

    def _best(self, part: str) -> tuple[int, ...]:
        n = len(part)
        best: list[float | None] = [None] * (n + 1)
        last: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # start and id of the piece that ends here
        best[0] = 0.0
        merges = self.kind == "bpe"
        done, single = 0, False  # single: a piece of one character ends at ``done``
        for end, (size, score, i) in self.trie.iter(part):
            to, start = end + 1, end + 1 - size
            while done < to:  # positions come in order, the longest piece first
                if done and not single:
                    self._unknown(best, last, done)
                done, single = done + 1, False
            single |= size == 1
            s = best[start]
            if s is None:
                continue
            s += score
            now = best[to]
            if now is None or s > now and not merges:
                if not merges or start == 0 or self._beside(last[start], part[last[start][0] : start], i, part[start:to]):
                    best[to], last[to] = s, (start, i)
        while done <= n:
            if done and not single:
                self._unknown(best, last, done)
            done, single = done + 1, False
        path = []
        at = n
        while at:
            start, i = last[at]
            path.append((start, at, i))
            at = start
        out: list[int] = []
        was_unknown = False
        for start, end, i in reversed(path):
            if i != self.unknown:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in part[start:end].encode("utf-8", "replace")]
            elif not was_unknown:
                out.append(i)  # the library joins neighbouring unknown characters
            was_unknown = i == self.unknown
        return tuple(out)

    def _unknown(self, best, last, to: int) -> None:
        """A character that is no piece: a step of its own, worse than any piece."""
        before, now = best[to - 1], best[to]
        if before is not None and (now is None or self.kind != "bpe" and before + self.penalty > now):
            best[to], last[to] = before + self.penalty, (to - 1, self.unknown)

    def _beside(self, before: tuple[int, int], left: str, i: int, right: str) -> bool:
        """Whether merging the characters of two neighbouring pieces leaves exactly these two."""
        key = before[1] << 32 | i if before[1] != self.unknown else (left, right)
        got = self.stays.get(key)
        if got is None:
            if len(self.stays) > 400_000:
                self.stays.clear()
            got = self.stays[key] = self.merged(left + right) == [left, right]
        return got

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges: again and again the neighbours whose union has the highest score, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            at, top = -1, 0.0
            for j in range(len(parts) - 1):
                i = self.id_of.get(parts[j] + parts[j + 1])
                if i is not None and (at < 0 or self.score[i] > top):
                    at, top = j, self.score[i]
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def decode(self, ids) -> str:
        """Text of ids: pieces in a row, runs of byte pieces as UTF-8, without the leading space."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.piece[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return n, at


def _fields(b: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            value, at = _varint(b, at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else _varint(b, at)
            value, at = b[at : at + size], at + size
        yield key >> 3, value


def _model_type(model: bytes) -> str:
    """unigram or bpe, from the trainer's settings (field 2, entry 3; unigram where it is unset)."""
    spec = next((v for k, v in _fields(model) if k == 2), b"")
    kind = next((v for k, v in _fields(spec) if k == 3), 1)
    if kind not in (1, 2):
        raise ValueError("word and character models have no Viterbi")
    return "unigram" if kind == 1 else "bpe"


def codec(model: bytes) -> Codec:
    """The codec of a model, one per worker."""
    return resident(f"pieces {hashlib.sha1(model).hexdigest()}", lambda: Codec(model))


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver and sent to the tasks (about half a megabyte; 32 MB is the bound)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read((32 << 20) + 1)
    if len(model) > 32 << 20:
        raise ValueError("the model is larger than 32 MB")
    return model


def encode(docs: DataFrame, model: bytes, *, text: str = "text", check: bool = True) -> DataFrame:
    """Add ids (array<int>), n_pieces and, with ``check``, round_trip: whether decoding gives the text again.

    Null and empty texts have no ids. A text that holds the space mark U+2581 itself decodes to spaces there, as in the
    library, and is not round-trip. Columns of these names in ``docs`` are replaced.
    """
    src = docs.drop("ids", "n_pieces", "round_trip")
    shared, at, names = docs.sparkSession.sparkContext.broadcast(model), src.columns.index(text), src.columns

    def work(batches):
        c = codec(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            ids = [c.encode(t) for t in texts]
            extra = [pa.array([c.decode(x) == t for x, t in zip(ids, texts, strict=True)])] if check else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), *extra], names=[*names, "ids", "n_pieces", *["round_trip"] * check])

    return in_batches(src, work, extended(src, "ids array<int>, n_pieces long" + ", round_trip boolean" * check), keeps=True)


def decode(df: DataFrame, model: bytes, *, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of an array of ids; null arrays give null."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def work(column):
        c = codec(shared.value)
        return column.map(lambda x: None if x is None else c.decode(x))

    return df.withColumn(out, work(F.col(ids)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, model_bytes())
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("n_pieces").alias("n_tokens"),
                      F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary"), 256).alias("ids_sha256"), "round_trip")
