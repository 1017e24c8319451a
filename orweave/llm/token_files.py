"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Format of a shard (a pair of files, little-endian, no header):

* ``<name>.ids``  the token ids of the shard's documents one after another, unsigned 16-bit
  where the vocabulary allows it, else 32-bit;
* ``<name>.off``  two 64-bit columns, one after another: n + 1 offsets (in ids, from the
  shard's first id) and n document ids; a null document id is stored as the least long.

Shards hold ascending ranges of document ids; a shard's base, the number of ids before it, is
the prefix sum over the manifest (one row per shard). Both files are memory-mapped when read.
A task writes under a name of its own attempt and only the manifest row of the attempt that
Spark commits names it, so a repeated or lost task leaves no half shard in the output.

Defined cases: a null or empty text gives the end id alone; very long texts are encoded whole, each in a
slice of its own; rows with equal ids keep one record each, ordered by a hash of the text; null ids come
first; an empty table gives an empty manifest; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orweave.llm import common

NULL_ID = -(2**63)
_encoders: dict[tuple, "WordEncoder"] = {}


#: Letters, digits, ASCII signs but the apostrophe and single line breaks: what the split pattern parts runs of which are easily told.
_RUN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++|[0-9]++|[!-&(-/:-@\\[-`{-~]++"
RUNS = re.compile(f"{_RUN}|\n")
PLAIN = re.compile(f"(?:{_RUN}|(?<!\n)\n(?!\n))+")


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library and remembers words.

    The tokenizer's split pattern always cuts before a single space between two characters
    that are not white space, so a text is the concatenation of its space-led words and equal
    words get equal ids; a word is the concatenation of its runs of letters, digits or signs. A text for
    which this doesn't hold (an edge of a word is white space, or a special token occurs) is encoded
    as a whole, and so is every text if the file describes any other tokenizer than byte-level BPE
    with that pattern and nothing before or after it. ``room`` bounds the remembered words.
    """

    def __init__(self, path: str, dtype: str, room: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.model, self.dtype, self.room = (t := Tokenizer.from_file(path)), t.model, dtype, room
        self.plain = _splits_at_spaces(json.loads(t.to_str()))
        self.code = "H" if dtype == "<u2" else "I"
        self.special = [a.content for a in t.get_added_tokens_decoder().values()]
        # The byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest follows from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}
        self.space = chr(self.alphabet[32])
        #: Ids of words with a space before them and of runs without one; the first ``room`` words, and later ones for a while.
        self.words, self.late, self.runs = _Missing(self._word), {}, _Missing(self._run)

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a string that the split pattern keeps in one piece."""
        written = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.model.tokenize(written)])

    def _run(self, run: str) -> bytes:
        if len(self.runs) >= self.room // 4:
            self.runs.clear()
        found = self.runs[run] = self._piece(run)
        return found

    def _word(self, word: str) -> bytes | None:
        """Ids of the word with a space before it; None if the word can't stand alone."""
        if (known := self.late.get(word)) is not None:
            return known
        found = self._encode(word)
        if len(self.words) < self.room:
            self.words[word] = found
        elif found is not None:
            if len(self.late) >= self.room // 4:
                self.late.clear()
            self.late[word] = found
        return found

    def _encode(self, word: str) -> bytes | None:
        if word.isalpha():
            return self._piece(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if PLAIN.fullmatch(word):
            first, *rest = RUNS.findall(word)
            return b"".join([self.words[first] if first != word else self._piece(" " + word), *map(self.runs.__getitem__, rest)])
        return self._pack(self.tokenizer.encode(" " + word, add_special_tokens=False).ids)

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _first(self, word: str) -> bytes:
        """Ids of the word that a text begins with."""
        if PLAIN.fullmatch(word):
            return b"".join(map(self.runs.__getitem__, RUNS.findall(word)))
        return self.whole(word)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow array of strings; distinct words of the array are looked up once."""
        texts = pc.fill_null(texts, "")
        if not self.plain:
            return list(map(self.whole, texts.to_pylist()))
        odd = reduce(np.logical_or, [pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.special], np.zeros(len(texts), bool))
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        coded = split.values[bounds[0] : bounds[-1]].dictionary_encode()
        bounds = bounds - bounds[0]
        found = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        alone = np.fromiter((f is not None for f in found), bool, len(found))
        codes = coded.indices.to_numpy()
        joined = pa.array([f or b"" for f in found], pa.large_binary()).take(coded.indices)
        offsets, data = np.frombuffer(joined.buffers()[1], np.int64).tolist() if len(joined) else [0], joined.buffers()[2]
        data = memoryview(data) if data else b""
        # Up to each word, how many can't stand alone.
        bad = np.concatenate([[0], np.cumsum(~alone[codes])])
        odd |= bad[bounds[1:]] > bad[np.minimum(bounds[:-1] + 1, bounds[1:])]
        out = []
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            first = split.values[int(split.offsets[i].as_py())].as_py() if b > a else ""
            if odd[i] or b - a > 1 and (not first or first[-1].isspace()):
                out.append(self.whole(texts[i].as_py()))
            else:
                out.append(self._first(first) + data[offsets[a + 1] : offsets[b]] if b - a > 1 else self._first(first))
        return out


class _Missing(dict):
    def __init__(self, find):
        self.find = find

    def __missing__(self, key: str):
        return self.find(key)


def _splits_at_spaces(file: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with the usual split pattern, without anything that sees more than a piece."""
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    bare = not file.get("normalizer") and not file.get("truncation") and not file.get("padding") and (file.get("post_processor") or {"type": "ByteLevel"})["type"] == "ByteLevel"
    return bool(plain and bare and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges"))


def _open(path: str):
    """(file system, path in it) of a shared folder; local paths are opened directly."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _map(path: str, dtype: str) -> np.ndarray:
    """Memory-map a file; on a remote store its bytes are read."""
    system, inner = _open(path)
    if system.type_name == "local":
        return np.memmap(inner, dtype=dtype, mode="r") if os.path.getsize(inner) else np.empty(0, dtype)
    with system.open_input_file(inner) as f:
        return np.frombuffer(f.read(), dtype=dtype)


@dataclass
class TokenFiles:
    """A written set of shards: path, width of an id, and (name, documents, ids, base) per shard."""

    path: str
    dtype: str
    shards: list[tuple[str, int, int, int]]

    def documents(self, spark: SparkSession) -> DataFrame:
        """Read the files back: doc_id, start, n_tokens, ids_crc32 per document, one task per few shards."""
        common.ship(spark)
        path, dtype = self.path, self.dtype
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
        rows = spark.createDataFrame([s for s in self.shards if s[1]], "name string, n_docs long, n_ids long, base long")

        def back(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    ids, off = _map(f"{path}/{row['name']}.ids", dtype), _map(f"{path}/{row['name']}.off", "<i8")
                    n = row["n_docs"]
                    starts, names = off[: n + 1], off[n + 1 :]
                    for at in range(0, n, 4096):
                        to = min(n, at + 4096)
                        sums = [zlib.crc32(ids[starts[i] : starts[i + 1]].astype("<u4")) for i in range(at, to)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[at:to], pa.int64(), mask=np.asarray(names[at:to]) == NULL_ID), pa.array(starts[at:to] + row["base"]), pa.array(np.diff(starts[at : to + 1])), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

        return rows.repartition(max(1, min(len(self.shards), 4096))).mapInArrow(back, schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every whole text, append ``end_id``, and write shards in ascending order of ids.

    One range shuffle by id orders the corpus; encoding happens after it, so only texts are
    moved. The manifest has one row per shard; nothing else reaches the driver.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    common.ship(spark)
    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.size_of(docs) // (64 << 20))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def shard(batches):
        key = (tokenizer, dtype)
        if key not in _encoders:
            _encoders[key] = WordEncoder(tokenizer, dtype)
        encode, width = _encoders[key].encode, np.dtype(dtype).itemsize
        end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"shard-{part:06d}-{uuid.uuid4().hex[:12]}"
        system, inner = _open(path)
        system.create_dir(inner, recursive=True)
        offsets, names = [0], []
        with system.open_output_stream(f"{inner}/{name}.ids") as out:
            for batch in batches:
                for some in common.slices(batch, 1):
                    names += some.column(0).to_pylist()
                    for ids in encode(common.strings(some.column(1))):
                        out.write(ids + end)
                        offsets.append(offsets[-1] + len(ids + end) // width)
        with system.open_output_stream(f"{inner}/{name}.off") as out:
            out.write(np.array(offsets, "<i8").tobytes())
            out.write(np.array([NULL_ID if n is None else n for n in names], "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [len(names)], "n_ids": [offsets[-1]]})

    manifest = common.table(rows.mapInArrow(shard, "part long, name string, n_docs long, n_ids long"), "manifest").orderBy("part").collect()
    bases = [0, *accumulate(r.n_ids for r in manifest)]
    return TokenFiles(path, dtype, [(r.name, r.n_docs, r.n_ids, b) for r, b in zip(manifest, bases, strict=False)])
