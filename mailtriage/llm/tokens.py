"""Token counts of whole texts by a whole-token shortcut.

Offline, the driver encodes every vocabulary string of the tokenizer alone and keeps those that are
one pre-token and encode as one token: the proven strings, at most the vocabulary. A text is split
into the tokenizer's pre-tokens; a pre-token that is proven counts 1 without any merging; the rest
are merged by the library, once per distinct string of a batch. Byte-pair encoding never merges
across pre-tokens, so the sum is the library's count.

The split is done with the tokenizer's published pattern in Python's regex module. The two
libraries may class a character differently; prove() compares them on the code points below
PROVEN_POINTS, and a text with one that differs or lies above is encoded whole by the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PROVEN_POINTS = 0x10000


@dataclass(frozen=True)
class Proof:
    """What the offline step found: strings that are one token; code points below PROVEN_POINTS
    that are split otherwise by the two libraries; the added tokens' strings."""

    whole: frozenset[str]
    doubtful: frozenset[int]
    special: tuple[str, ...]


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary: bytes that print stand
    for themselves, the others follow from code point 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove(path: str) -> Proof:
    """The offline step, over the whole vocabulary and the code points below PROVEN_POINTS."""
    import json

    import regex
    from tokenizers import Tokenizer

    _refuse_others(json.load(open(path)))
    tokenizer = Tokenizer.from_file(path)
    split = regex.compile(PATTERN)
    letters = byte_letters()
    strings = []
    for s in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(letters[c] for c in s).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    special = tuple(sorted(t["content"] for t in json.load(open(path))["added_tokens"]))
    whole = set()
    for at in range(0, len(strings), 4096):
        part = strings[at : at + 4096]
        for s, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            if len(e.ids) == 1 and s not in special and len(split.findall(s)) == 1:
                whole.add(s)
    points = [chr(c) for c in range(PROVEN_POINTS) if not 0xD800 <= c <= 0xDFFF]
    doubtful = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = _members(tokenizer, points, name)
        doubtful |= theirs ^ {ord(p) for p in points if regex.match(name, p)}
    return Proof(frozenset(whole), frozenset(doubtful), special)


def _refuse_others(spec: dict) -> None:
    """PATTERN is the split of byte-level BPE; a file with another split or a normaliser is an error."""
    split = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        raise ValueError("the tokenizer file must be byte-level BPE with the published split, without normaliser or prefix space")


def _members(tokenizer, points: list[str], name: str) -> set[int]:
    """Code points of a class as the tokenizer sees it: one of the class stays joined to the
    neighbour of that class before it."""
    left = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\n"}[name]
    found: set[int] = set()
    for at in range(0, len(points), 128):
        part = points[at : at + 128]
        # "!" ends each probe: a mark never joins letters, digits or blanks before it.
        probe = "".join(f"!{left}{p}{left}" for p in part)
        starts = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)}
        place = 0
        for p in part:
            if place + 2 not in starts:
                found.add(ord(p))
            place += 4
    return found


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per row of docs.

    Counts are the library's for the whole text, without begin, end or padding tokens; an added
    token's string inside a text is one token, as the library has it by default. Null text is
    empty and counts 0. Null ids and repeated rows stay; other columns are ignored.
    """
    spark = docs.sparkSession
    proof = spark.sparkContext.broadcast(prove(path))  # bounded by the vocabulary and Unicode

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from tokenizers import Tokenizer

        known, tokenizer, split = proof.value, Tokenizer.from_file(path), regex.compile(PATTERN).findall
        doubt = regex.compile("[" + "".join(map(re.escape, map(chr, sorted(known.doubtful)))) + chr(PROVEN_POINTS) + "-\U0010ffff]").search
        special = re.compile("|".join(map(re.escape, sorted(known.special, key=len, reverse=True)))) if known.special else None
        sizes = dict.fromkeys(known.whole, 1)
        first = len(sizes)
        for batch in batches:
            if len(sizes) > first + 400_000:  # forget merged strings, keep proven ones
                sizes = dict.fromkeys(known.whole, 1)
            tokens = []
            for text in batch.column(1).to_pylist():
                if doubt(text):
                    tokens.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
                    continue
                n, parts = 0, [text]
                if special and special.search(text):
                    parts = special.split(text)
                    n = len(parts) - 1
                for part in parts:
                    pieces = split(part)
                    try:
                        n += sum(map(sizes.__getitem__, pieces))
                    except KeyError:
                        new = [p for p in set(pieces) if p not in sizes]
                        for p, e in zip(new, tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                            sizes[p] = len(e.ids)
                        n += sum(map(sizes.__getitem__, pieces))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"), F.octet_length(text_of()).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
