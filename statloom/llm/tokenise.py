"""Token ids of texts under a public tokenizer file, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

#: The byte-level alphabet of the JSON vocabularies and their published split pattern.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHED = 400_000        # words kept by a worker; beyond them it starts anew


def _byte_of() -> dict[str, int]:
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(other)}


def _as_ranks(spec: dict):
    """The vocabulary as (bytes -> id, special -> id) if ids follow the order of the merges, else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model.get("type") == "BPE"
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")))
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if not plain or any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        return None
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    if ids != list(range(ids[0], ids[0] + len(ids))) or len(model["vocab"]) != ids[-1] + 1 + sum(s in model["vocab"] for s in special):
        return None
    byte = _byte_of()
    return {bytes(byte[c] for c in tok): i for tok, i in model["vocab"].items() if tok not in special}, special


class _Words(dict):
    """Packed ids of words with the space before them, encoded when first asked for."""

    def __init__(self, pack):
        super().__init__()
        self.pack = pack

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.pack(" " + word)
        return ids


class Encoder:
    """Encodes texts. Ids are those of `tokenizers` (or `sentencepiece` for a .model file), no special tokens added.

    Byte-level vocabularies are cut at spaces first: no token of theirs reaches over the place before a space that
    follows a non-space and precedes one, so words can be encoded once and looked up afterwards. Texts with other
    spacing are encoded whole.
    """

    def __init__(self, path: str):
        self.words = _Words(self._pack)
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.cut = (lambda t: model.encode(t, num_threads=1)), False
            return
        with open(path, encoding="utf-8") as f:
            ranks = _as_ranks(json.load(f))
        if ranks is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            self.whole, self.cut = (lambda t: tok.encode(t, add_special_tokens=False).ids), False
            return
        import tiktoken
        enc = tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks[0], special_tokens=ranks[1])
        special = set(ranks[1])
        self.whole, self.cut = (lambda t: enc.encode(t, allowed_special=special) if any(s in t for s in special) else enc.encode_ordinary(t)), True
        self.odd = re.compile(r" \s| \Z")

    def _pack(self, text: str) -> bytes:
        ids = array("I", self.whole(text))
        return ids.tobytes() if ids.itemsize == 4 and sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        if not self.cut or self.odd.search(text):
            return self._pack(text)
        first, *rest = text.split(" ")
        if len(self.words) > CACHED:
            self.words.clear()
        return self._pack(first) + b"".join([self.words[w] for w in rest])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
