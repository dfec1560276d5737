"""Token counts by the whole-token shortcut, and the encoder that packing shares.

A byte-level BPE tokenizer first cuts a text into pre-tokens and merges bytes inside each one. Two
facts are proved offline, on the driver, before a job starts (``prove``):

* *Whole tokens.* Every vocabulary string that is valid UTF-8, is one pre-token and encodes alone as
  exactly one id. A pre-token found in this set counts as one token; only the others are merged.
* *Safe cuts.* The pattern never lets a pre-token run over the border from a non-space to a white-space
  character, so a text may be cut there into chunks (white space, then non-space) that encode
  independently. White space that Python and the tokenizer class differently is listed at load;
  texts holding such characters are encoded whole.

Merges themselves run in ``tokenizers``, or in the faster ``tiktoken`` when the vocabulary's own merge
table makes both the same: ids rise in merge order and every token is rebuilt by its own merges, so in
every state the two see the same candidate pairs in the same order. Texts with characters beyond
``SLOW_CHAR``'s bound or with a special string always go to ``tokenizers``.

Workers keep a bounded memo of chunks (emptied when full), which changes speed only.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from .common import ship  # noqa: E402

MEMO_CHUNKS = 400_000  # entries a worker remembers; about 60 MB
MEMO_CHARS = 64  # longer chunks are not remembered

_CHUNK = re.compile(r"\s*\S+|\s+")
#: Fixed value: the pre-token pattern of the byte-level vocabulary, as its publisher states it.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLOW_CHAR = re.compile("[^\x00-\u024f]")  # below it both pattern engines class every character alike (tested)


class _Memo(dict):
    """chunk -> value, computed when first asked for; never holds more than MEMO_CHUNKS entries."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, chunk):
        value = self.compute(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_CHUNKS:
                self.clear()
            self[chunk] = value
        return value


def read_tokenizer(path: str) -> tuple[str, bytes]:
    """('json', bytes) or ('model', bytes): the file travels with the job, so executors need no copy."""
    with open(path, "rb") as f:
        return ("model" if path.endswith(".model") else "json"), f.read()


def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=8)
def prove(kind: str, data: bytes) -> dict:
    """What holds for this tokenizer file (module docstring).

    Returns ``chunked`` (chunks may be encoded alone), ``odd`` (characters that rule chunking out),
    ``specials``, ``whole`` (strings that are one token alone) and ``ranks`` (for ``tiktoken``, or None).
    """
    none = {"chunked": False, "odd": "", "specials": (), "whole": frozenset(), "ranks": None}
    if kind != "json":
        return none
    from tokenizers import Tokenizer

    spec = json.loads(data)
    tok = Tokenizer.from_str(data.decode())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens") or []
    if (pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer")
            or spec.get("truncation") or spec.get("padding") or model.get("type") != "BPE" or model.get("ignore_merges")
            or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
            or any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added)):
        return none
    cut = tok.pre_tokenizer.pre_tokenize_str
    spaces = [chr(c) for c in range(0x110000) if re.match(r"\s", chr(c))]
    odd = "".join(c for c in spaces if [s for _, s in cut(f"a{c}{c}b")][1] == (1, 3))

    alphabet, specials = _byte_chars(), {a["content"] for a in added}
    whole, own_merges = [], True
    for piece, i in model["vocab"].items():
        if piece in specials:
            continue
        raw = bytes(alphabet[ch] for ch in piece)
        alone = [t.id for t in tok.model.tokenize(piece)] == [i]
        own_merges &= alone
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if alone and len(cut(text)) == 1:
            whole.append(text)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    ranks = None
    if own_merges and ids == sorted(ids) and len(set(ids)) == len(ids) == len(model["vocab"]) - 256 - len(specials & set(model["vocab"])):
        ranks = {bytes(alphabet[ch] for ch in p): i for p, i in model["vocab"].items() if p not in specials}
    return {"chunked": True, "odd": odd, "specials": tuple(sorted(specials)), "whole": frozenset(whole), "ranks": ranks}


class Encoder:
    """Ids and counts of whole texts, exactly as the tokenizer's own library gives them."""

    def __init__(self, kind: str, data: bytes, facts: dict):
        self.kind, self.facts = kind, facts
        if kind == "model":
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(data.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        self.bpe = None
        if facts["ranks"]:
            import tiktoken

            self.bpe = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=facts["ranks"], special_tokens={})
        self.odd = re.compile("[" + re.escape(facts["odd"]) + "]") if facts["odd"] else None
        if facts["chunked"]:
            import regex

            self.cut = regex.compile(PRE_TOKEN).findall
            self.count_of = _Memo(self._chunk_count)
            self.count_of.update(dict.fromkeys(facts["whole"], 1))

    def _ids(self, text: str) -> list[int]:
        if self.kind == "model":
            return self.sp.encode(text, num_threads=1)
        return self.tok.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> bool:
        """Both pattern engines agree on this text and it holds no special string."""
        latin = text.isascii() or len(text.encode("latin-1", "ignore")) == len(text)  # all below the bound, told at once
        return (latin or SLOW_CHAR.search(text) is None) and not any(s in text for s in self.facts["specials"])

    def _chunk_count(self, chunk: str) -> int:
        if not self._plain(chunk):
            return len(self._ids(chunk))
        whole, n = self.facts["whole"], 0
        for pre in self.cut(chunk):
            n += 1 if pre in whole else len(self.bpe.encode_ordinary(pre) if self.bpe else self._ids(pre))
        return n

    def _chunks(self, text: str) -> list[str] | None:
        if not self.facts["chunked"] or (self.odd and self.odd.search(text)):
            return None
        return _CHUNK.findall(text)

    def encode(self, text: str) -> np.ndarray:
        """The whole text's ids as unsigned 32-bit integers."""
        if self.kind == "json" and self.bpe and self._plain(text):
            return np.array(self.bpe.encode_ordinary(text), np.uint32)  # faster than its own way to an array
        return np.array(self._ids(text), np.uint32)

    def count(self, text: str) -> int:
        if (chunks := self._chunks(text)) is None:
            return len(self._ids(text))
        return sum(map(self.count_of.__getitem__, chunks))


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(kind: str, data: bytes, facts: dict) -> Encoder:
    """One encoder per worker process and tokenizer file, kept between its tasks."""
    key = hash((kind, data))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(kind, data, facts)
    return _ENCODERS[key]


def token_counts(df: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``df`` with the token count of every whole text in ``out_col`` (long).

    A null or empty text has 0 tokens; special strings inside texts count as the library's default has
    it; no begin, end or padding tokens. Byte-level BPE ``.json`` files take the whole-token shortcut,
    other ``.json`` files and sentencepiece ``.model`` files (whose pieces may cross white space) are
    counted by their library. Rows are independent: no shuffle, repeated rows stay, an empty table gives
    an empty one. Other columns pass through; one already named ``out_col`` is replaced.
    """
    kind, data = read_tokenizer(tokenizer)
    shared = ship(df.sparkSession).sparkContext.broadcast((kind, data, prove(kind, data)))  # bounded by the vocabulary file

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = worker_encoder(*shared.value)
        for texts in batches:
            yield pd.Series([0 if t is None else enc.count(t) for t in texts], dtype="int64")

    counted = F.pandas_udf(count, T.LongType())(F.col(f"`{text_col}`"))
    return df.withColumn(out_col, counted)
