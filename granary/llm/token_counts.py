"""Token counts by a public tokenizer file, computed in Arrow functions that return lengths only.

Texts are taken in groups of about ``CHUNK`` bytes, whatever their number.  What else is safe depends on the file:

* ``words`` (a pre-tokenizer that drops white space, none of whose special tokens contains any): a longer text is cut
  into pieces of at most that size at a space or line feed; a stretch without any is one piece.  Normalisation treats the
  boundary as a starter, and equal words have equal counts, so each group is encoded as its distinct new words.
* ``whole`` (any other ``.json``, and ``.model`` by sentencepiece): no boundary is safe for every such file, so each text
  is encoded as it is.

Defined results: a null text is empty and has 0 bytes and 0 tokens; special strings inside a text count as the
library counts them by default; rows are kept one for one, whatever their ids; extra columns are ignored; a file of
another kind raises.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Distinct words remembered by one worker; beyond it the memory starts afresh, which changes no result.
REMEMBERED = 500_000


def _splits_at_blanks(spec: dict) -> bool:
    """Whether white space parts words for this tokenizer file and is never itself in a token."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    drops = first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        pattern = first.get("pattern", {}).get("Regex", "")
        # Character classes that can't match white space.
        rest = pattern
        for known in (r"[^\s\p{L}\p{N}]", r"[\p{L}]", r"[\p{N}]", r"\p{L}", r"\p{N}"):
            rest = rest.replace(known, "")
        drops = not any(c in rest for c in ("\\", "[", ".", " "))
    blank = any(any(c.isspace() for c in t.get("content", "")) for t in spec.get("added_tokens", []))
    prefix = any(s.get("add_prefix_space") for s in steps)
    marks = json.dumps(spec.get("normalizer") or {})
    return drops and not blank and not prefix and "Prepend" not in marks and "Strip" not in marks


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """(kind, function from texts to numbers of tokens)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return "whole", lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if not path.endswith(".json"):
        raise ValueError(f"neither .json nor .model: {path}")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        kind = "words" if _splits_at_blanks(json.load(f)) else "whole"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return kind, lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _pieces(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut < at:  # no boundary in reach: go on to the next one
            later = [x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0]
            if not later:
                break
            cut = min(later)
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class Counter:
    """Counts tokens of texts; remembers the counts of words."""

    def __init__(self, path: str, chunk: int = CHUNK, remembered: int = REMEMBERED) -> None:
        (self.kind, self.encode), self.chunk, self.remembered = _tokenizer(path), chunk, remembered
        self.known: dict[str, int] = {"": 0}

    def _group(self, texts: list[str]) -> list[int]:
        if self.kind == "whole":
            return self.encode(texts)
        words = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*words).difference(self.known)) if words else []
        if len(self.known) + len(new) > self.remembered:
            self.known = {"": 0}
            new = list(set().union(*words).difference(self.known))
        if new:
            self.known.update(zip(new, self.encode(new), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, w)) for w in words]

    def counts(self, column: pa.Array) -> list[int]:
        """Numbers of tokens of the texts, in groups by their bytes."""
        out, group, owner, size = [0] * len(column), [], [], 0

        def flush() -> None:
            nonlocal group, owner, size
            for i, n in zip(owner, self._group(group) if group else (), strict=True):
                out[i] += n
            group, owner, size = [], [], 0

        for i, (text, n_bytes) in enumerate(zip(column.to_pylist(), pc.binary_length(column).to_pylist(), strict=True)):
            if not text:
                continue
            # A quarter of the bytes in characters is never more than the bytes.
            pieces = list(_pieces(text, self.chunk // 4)) if self.kind == "words" and n_bytes > self.chunk else [text]
            for piece in pieces:
                group.append(piece)
                owner.append(i)
                size += n_bytes // len(pieces)
                if size >= self.chunk:
                    flush()
        flush()
        return out


def _count(name: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path or tokenizer_path(name))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counter.counts(b.column(2)), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, *, limit: int = 2048, tokenizer: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row; ``path`` overrides where the tokenizer file lies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(_count(tokenizer, path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
