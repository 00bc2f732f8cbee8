"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that stand next to each other inside no vocabulary
token can never be merged across, so a cut between them is certain. Each piece
of a text is cut at all such pairs, the fragments are encoded independently (the
last with the end-of-word suffix) and their ids are concatenated.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows are encoded alike; extra columns pass through; a very long text is
taken in pieces cut at white space, and one without white space is one chunk,
whatever its length; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from .common import OBJECT, annotate, fresh, pieces

#: Bytes of chunks and words that a worker gathers in one generation; it remembers two, and forgets them with its task.
CACHE = 48 << 20
#: Chunks of more bytes are not remembered.
LONG = 64
#: Letters beyond ASCII that are taken without the library's normaliser if it maps them one to one.
PLAIN_LETTERS = range(0xC0, 0x180)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes whole texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, cache: int = CACHE):
        spec = json.load(open(path, encoding="utf-8"))
        whole, model = Tokenizer.from_file(path), spec["model"]
        self.normal, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = dict(vocab=model["vocab"], merges=merges)
        self.inner = models.BPE(**plain)
        self.last = models.BPE(**plain, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([token.get(i) for i in range(max(token, default=-1) + 1)], pa.large_string())
        self.marked = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.mark = re.compile(b"|".join(re.escape(m.encode()) for m in self.special) or b"(?!)")
        self.within: set[tuple[str, str]] = set()
        for t in model["vocab"]:
            body = t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
            self.within.update(zip(body, body[1:]))
        self.alphabet = byte_alphabet()
        # Chunks of ASCII and such letters need no library call before the merges.
        kept = {c: self.normal.normalize_str(chr(c)) for c in PLAIN_LETTERS}
        self.lower = {c: n for c, n in kept.items() if len(n) == 1 and n.isalpha() and ord(n) in PLAIN_LETTERS}
        self.lower |= {c: chr(c + 32) for c in range(65, 91)}
        letters = "".join(sorted(map(re.escape, set(self.lower.values()) | set("abcdefghijklmnopqrstuvwxyz"))))
        self.simple = re.compile("[!-~" + "".join(map(re.escape, map(chr, self.lower))) + letters + "]+")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+")
        self.cache = cache
        self._afresh()

    def _afresh(self) -> None:
        """Start a generation; what the last one knew is still at hand, and older things are forgotten."""
        self.old_known, self.old_words = getattr(self, "known", {}), getattr(self, "words", {})
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self._afresh()
        self._afresh()

    def fragments(self, piece: str) -> list[str]:
        """Cut a piece (in the byte alphabet) wherever no token could reach across."""
        if self.within.issuperset(zip(piece, piece[1:])):
            return [piece]
        out, start, within = [], 0, self.within
        for i, pair in enumerate(zip(piece, piece[1:]), 1):
            if pair not in within:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def encoded(self, piece: str) -> bytes:
        """A piece in the byte alphabet to its ids (as int32 bytes)."""
        *inner, last = self.fragments(piece)
        tokens = [t.id for x in inner for t in self.inner.tokenize(x)]
        return array("i", tokens + [t.id for t in self.last.tokenize(last)]).tobytes()

    def word(self, piece: str) -> bytes:
        """The same for a piece of plain text."""
        found = self.words.get(piece)
        if found is None:
            found = self.old_words.get(piece)
            if found is None:
                found = self.encoded(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet))
            if len(piece) > LONG:
                return found
            self.words[piece] = found
            self.held += 2 * OBJECT + len(piece) + len(found)
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        return b"".join([self.encoded(p) for p, _ in self.splitter.pre_tokenize_str(self.normal.normalize_str(text))])

    def learn(self, raw: bytes) -> bytes:
        """Ids of a stretch without ASCII white space."""
        text = raw.decode("utf-8", "replace")
        if self.mark.search(raw) is None:
            if self.simple.fullmatch(text):
                return b"".join([self.word(p) for p in self.pieces.findall(text.translate(self.lower))])
            return self.plain(text)
        out, at = [], 0
        for m in self.marked.finditer(text):
            out += [self.plain(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join(out) + self.plain(text[at:])

    def text(self, raw: bytes) -> bytes:
        """The ids (as int32 bytes) of a whole text."""
        ids = []
        for piece in pieces(raw):
            block = piece.split()
            if self.held > self.cache:
                self._afresh()
            own, long = self.known, []
            for c in set(block).difference(own):
                found = self.old_known.get(c)
                own[c] = found = self.learn(c) if found is None else found
                if len(c) > LONG:
                    long.append(c)
                else:
                    self.held += 2 * OBJECT + len(c) + len(found)
            ids += map(own.__getitem__, block)
            for c in long:
                del own[c]
        return b"".join(ids)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """As the library decodes without a decoder: tokens joined by a space."""
        tokens = pc.take(self.tokens, ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), pa.scalar(" ", pa.large_string())).cast(pa.string())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _work(path: str) -> Callable[[], Callable[[list[bytes]], list[pa.Array]]]:
    def start():
        enc = encoder(path)

        def work(texts: list[bytes]) -> list[pa.Array]:
            made = [enc.text(t) for t in texts]
            ends = np.cumsum([0, *(len(i) // 4 for i in made)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), np.int32)))
            return [ids, enc.decode(ids)]

        work.close = enc.forget
        return work

    return start


def round_trip(docs: DataFrame, path: str, text: str = "text", keep_text: bool = False) -> tuple[DataFrame, str, str]:
    """Encode every text and decode its ids again.

    Returns the rows with an ids column (array of int) and a decoded column
    (string), and the names those two columns got.
    """
    ids, decoded = fresh(docs, "ids", "decoded")
    out = annotate(docs, _work(path), [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())], text, keep_text)
    return out, ids, decoded


def decode(rows: DataFrame, path: str, ids: str = "ids") -> tuple[DataFrame, str]:
    """Decode a column of ids; a null list decodes to the empty text."""
    (name,) = fresh(rows, "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    columns = rows.columns

    def run(batches):
        enc = encoder(path)
        for b in batches:
            lists = b.column(columns.index(ids)).fill_null([])
            ends = pa.array(np.cumsum([0, *pc.list_value_length(lists).to_pylist()]).astype(np.int32))
            text = enc.decode(pa.ListArray.from_arrays(ends, lists.flatten().cast(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*columns, name])

    return rows.mapInArrow(run, schema), name
