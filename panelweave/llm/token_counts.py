"""Token counts: lengths of whole texts in a tokenizer's tokens, nothing else leaves the workers.

One narrow pass over (doc_id, text). Texts are cut at safe boundaries, places
that no token can span, as the vocabulary file itself proves (``rule_of``):

* Where the pre-tokenizer keeps nothing but runs without white space, every
  ASCII blank is such a place: blanks are dropped and nothing composes with one.
* Where it is byte-level with its usual pattern, the place before a blank that
  follows a visible ASCII character is one, as no alternative of the pattern
  goes on from such a character to a blank.
* For all other files whole texts are encoded.

The distinct pieces of an Arrow batch are encoded once, in groups balanced by
bytes, and the pieces' counts are added by text. Long pieces are cut further,
between a digit and a letter or digit, where each digit is a token of its own.

Defined cases: a null or empty text has 0 tokens; a very long text is one slice
and one sum; repeated rows are counted row by row; an empty table gives an
empty result; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import give_back, sliced, texts_only

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: How texts may be cut.
WHOLE, AT_BLANKS, BEFORE_BLANKS = "whole", "at blanks", "before blanks"
#: Safe where the pre-tokenizer makes each digit a token of its own.
SAFE_DIGIT = re.compile(r"(?<=[0-9])(?=[0-9A-Za-z])")
BEFORE_BLANK = re.compile(r"(?<=[!-~])(?=[ \n\t])")


def pieces(text: str, split_chars: int) -> list[str]:
    """Cut a piece without blanks at safe places into parts of about ``split_chars``; a stretch without one stays whole."""
    out, start = [], 0
    while len(text) - start > split_chars and (found := SAFE_DIGIT.search(text, start + split_chars)):
        out.append(text[start : found.end()])
        start = found.end()
    out.append(text[start:])
    return out


def _steps(part: dict | None, inner: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer."""
    return [] if part is None else part[inner] if part.get("type") == "Sequence" else [part]


def rule_of(path: str) -> tuple[str, bool]:
    """How texts may be cut for this vocabulary file, and whether each digit is a token of its own."""
    if not path.endswith(".json"):
        return WHOLE, False
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in file.get("added_tokens") or []):
        return WHOLE, False
    normal, cut = _steps(file.get("normalizer"), "normalizers"), _steps(file.get("pre_tokenizer"), "pretokenizers")
    if not normal and len(cut) == 1 and cut[0]["type"] == "ByteLevel" and cut[0].get("use_regex", True) and not cut[0]["add_prefix_space"]:
        return BEFORE_BLANKS, False
    # blanks may at most become other blanks; NFC joins nothing with them
    plain = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " ") for x in normal)
    if plain and cut and cut[0]["type"] == "Split" and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and "Regex" in cut[0]["pattern"]:
        pattern = cut[0]["pattern"]["Regex"]
        rest = pattern.replace("[^\\s", "[")  # what is left must not be able to match a blank
        if not re.search(r"[ .]|\[\^|\\[sWDPHRX]|\\[xut]", rest):
            return AT_BLANKS, bool(re.search(r"(^|\|)(\[\\p\{N\}\]|\\p\{N\})(\||$)", pattern))
    return WHOLE, False


def _load(path: str):
    """Texts -> list of lengths, for a .json or .model file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, batch_bytes: int = 1 << 19, split_bytes: int = 1 << 15, memo_bytes: int = 48 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row of ``docs``.

    tokenizer: path of the vocabulary file, readable on every worker. memo_bytes: about what a worker keeps of words seen
    lately and their lengths; it only saves time.
    """

    def balanced(texts: list[str], lengths_of) -> Iterator[int]:
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= batch_bytes:
                yield from lengths_of(group)
                group, held = [], 0
        yield from lengths_of(group)

    def cut_up(texts: pa.Array, rule: str) -> pa.ListArray:
        if rule == AT_BLANKS:
            return pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        return pa.array([BEFORE_BLANK.split(x) for x in texts.to_pylist()], pa.list_(pa.large_string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths_of = _load(tokenizer)
        rule, single_digits = rule_of(tokenizer)
        known: dict[str, int] = {}
        held = 0
        for batch in sliced(batches, 1, 4 << 20):
            texts = batch.column(1)
            if rule != WHOLE:
                lists = cut_up(texts, rule)
                coded = lists.flatten().dictionary_encode()
                names = coded.dictionary.to_pylist()
                if held > memo_bytes:
                    known, held = {}, 0
                fresh = [x for x in names if x not in known]
                held += sum(150 + len(x) for x in fresh)
                short = [x for x in fresh if len(x) <= split_bytes or not single_digits]
                known.update(zip(short, balanced(short, lengths_of), strict=True))
                for word in fresh:
                    if word not in known:
                        known[word] = sum(balanced(pieces(word, split_bytes), lengths_of))
                sizes = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
                sums = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy(zero_copy_only=False)])]) if len(coded) else np.zeros(1, np.int64)
                offsets = lists.offsets.to_numpy()
                offsets = offsets - offsets[0]
                n_tokens = pa.array(sums[offsets[1:]] - sums[offsets[:-1]])
            else:
                n_tokens = pa.array(balanced(texts.to_pylist(), lengths_of), pa.int64())
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        known.clear()
        give_back()

    return texts_only(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)
