"""Exact encoding with a merge-type SentencePiece model by backtracking, and decoding.

A token sequence is the merge result of its text exactly when every two neighbours are the
merge result of theirs.  So no merge queue runs over a text: Aho-Corasick gives the longest
pieces from left to right, each pair of neighbours is checked by merging its few characters
again (remembered per pair), and where a pair fails the search goes back to the next shorter
piece; a bitfield marks positions from which the rest failed, so none is tried twice.

No piece of a merge-type model crosses from a letter to a word mark, and no piece holds a
character without a piece of its own, so a text is encoded word by word; words seen before come
from a table of bounded size per worker, which saves time and changes nothing.

Defined results: null and empty texts give no tokens and an empty text; a character without a
piece becomes the byte tokens of its UTF-8 form; texts of any length are taken whole; rows and
their columns stay as they are, and clashing output names are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from winnow.llm.common import map_slices, table
from winnow.llm.registry import query

#: Words and token pairs a worker remembers.
WORDS_KEPT = 200_000
PAIRS_KEPT = 300_000

MARK = "▁"  # fixed value: the word mark of SentencePiece
MODEL = "piece_bpe_32k.model"
_CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


class MergeModel:
    """Pieces of a model file, the encoder and the decoder."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.special = {i for i in range(len(self.piece)) if sp.is_control(i)}
        self.unk = sp.unk_id()
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(len(self.piece)) if i not in self.special and i != self.unk
                 and i not in self.byte_of]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.chars = {p for p in self.id if len(p) == 1}
        if any(not set(p) <= self.chars or MARK in p.lstrip(MARK) for p in self.id) \
                or len(self.byte_id) != 256:
            raise ValueError(f"{path}: not a merge-type model with byte fallback")
        # a piece that its own merges do not give can never be in a result
        reachable = [p for p in self.id if len(p) == 1 or self.merged(p) == [p]]
        self.longest = ahocorasick.Automaton()
        for p in reachable:
            self.longest.add_word(p, p)
        self.longest.make_automaton()
        known = set(reachable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None)
                        for p in reachable}
        self.decimal = [str(i).encode() for i in range(len(self.piece))]
        self.surface = [None if i in self.byte_of else "" if i in self.special
                        else " ⁇ " if i == self.unk else p.replace(MARK, " ")
                        for i, p in enumerate(self.piece)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a few characters: best score first, leftmost of equal ones."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the text of two neighbours gives them back."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merged(a + b) == [a, b]
            if len(self.pairs) < PAIRS_KEPT:  # a bound on memory, the answer is the same
                self.pairs[a, b] = known
        return known

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters have a piece."""
        greedy = [p for _, p in self.longest.iter_long(text)]
        known, fits = self.pairs.get, self.fits
        last = greedy[0]
        for k in range(1, len(greedy)):
            piece = greedy[k]
            ok = known((last, piece))
            if ok is None:
                ok = fits(last, piece)
            if not ok:
                return self._backtrack(text, greedy[:k], piece)
            last = piece
        return greedy

    def _backtrack(self, text: str, out: list[str], piece: str) -> list[str]:
        """Go on from pieces that fit, with the next one to try."""
        n, at = len(text), sum(map(len, out))
        known, fits, shorter_of = self.pairs.get, self.fits, self.shorter
        longest = self.longest.iter_long
        open_ = (1 << (n + 1)) - 1
        while True:
            end = at + len(piece)
            ok = open_ >> end & 1
            if ok and out:
                ok = known((out[-1], piece))
                if ok is None:
                    ok = fits(out[-1], piece)
            if ok:
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = next(longest(text, at))[1]
                continue
            shorter = shorter_of[piece]
            while shorter is None:
                open_ &= ~(1 << at)  # no way on from here
                last = out.pop()
                at -= len(last)
                shorter = shorter_of[last]
            piece = shorter

    def runs(self, chunk: str) -> list[str]:
        """Pieces, and characters without a piece by themselves."""
        chars = self.chars
        if set(chunk) <= chars:
            return self.pieces(chunk)
        out, at = [], 0
        for i, c in enumerate(chunk):
            if c not in chars:
                if i > at:
                    out += self.pieces(chunk[at:i])
                out.append(c)
                at = i + 1
        if at < len(chunk):
            out += self.pieces(chunk[at:])
        return out

    def _word(self, key: str) -> tuple[int, bytes, str]:
        ids: list[int] = []
        for p in self.runs(key if key[:1] == "\n" else (" " + key).replace(" ", MARK)):
            i = self.id.get(p)
            if i is None:
                ids += [self.byte_id[b] for b in p.encode()]
            else:
                ids.append(i)
        out = (len(ids), b",".join([self.decimal[i] for i in ids]), self.spelled(ids))
        if len(self.words) < WORDS_KEPT:
            self.words[key] = out
        return out

    def encoded(self, text: str) -> tuple[int, bytes, str]:
        """(number of ids, ids in decimal joined by commas, text decoded from these ids)."""
        if not text:
            return 0, b"", ""
        text = text.replace(MARK, " ")
        keys = text.replace("\n", " \n").split(" ")
        if "" in keys:  # runs of spaces: the chunk keeps them together
            keys = [c[1:] if c[0] == " " else c for c in _CHUNK.findall(" " + text)]
        get, word = self.words.get, self._word
        found = [get(k) or word(k) for k in keys]
        return (sum([f[0] for f in found]), b",".join([f[1] for f in found]),
                "".join([f[2] for f in found])[1:])

    def spelled(self, ids: list[int]) -> str:
        """Text of ids in the middle of a sequence."""
        parts = [self.surface[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out: list[str] = []
        raw = bytearray()
        for i, part in zip(ids, parts):
            if part is None:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(part)
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def decoded(self, ids: list[int]) -> str:
        """Text of a whole sequence: the mark put before its first word goes."""
        first = next((i for i in ids if i not in self.special), None)
        text = self.spelled(ids)
        marked = first is not None and first not in self.byte_of and first != self.unk \
            and self.piece[first].startswith(MARK)
        return text[1:] if marked else text


def _utf8(raw: bytes) -> str:
    """Every byte that starts no whole character becomes one replacement character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> MergeModel:
    return MergeModel(path)


def encode(df: DataFrame, path: str, text: str = "text",
           outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """All columns of ``df`` and the wanted outputs.

    ``n_tokens``, ``ids`` (array of int), ``decoded`` (the text decoded from the ids), and the
    lowercase SHA-256 of the ids joined by commas (``ids_sha256``) and of the decoded text
    (``decoded_sha256``).
    """
    types = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string",
             "ids_sha256": "string", "decoded_sha256": "string"}
    if clash := set(outputs) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType(list(df.schema.fields)
                          + list(T._parse_datatype_string(
                              ", ".join(f"{o} {types[o]}" for o in outputs)).fields))
    where = df.columns.index(text)
    names = [*df.columns, *outputs]

    def setup():
        m = model(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made: dict[str, list] = {o: [] for o in outputs}
            for t in batch.column(where).to_pylist():
                n, ids, decoded = m.encoded(t or "")
                for o, values in made.items():
                    values.append(
                        n if o == "n_tokens"
                        else hashlib.sha256(ids).hexdigest() if o == "ids_sha256"
                        else hashlib.sha256(decoded.encode()).hexdigest() if o == "decoded_sha256"
                        else decoded if o == "decoded"
                        else np.array(ids.split(b",") if ids else [], dtype="S5").astype(np.int32))
            arrays = [pa.array(made[o], type=_ARROW[o]) for o in outputs]
            return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

        return work

    return map_slices(df, None, schema, setup)


_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(),
          "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of its id arrays; a null array gives an empty text."""
    if out in df.columns:
        raise ValueError(f"column {out} is there already")
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType())])
    where, names = df.columns.index(ids), [*df.columns, out]

    def setup():
        m = model(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [m.decoded(x or []) for x in batch.column(where).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, type=pa.string())], names=names)

        return work

    return map_slices(df, None, schema, setup)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, model_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
