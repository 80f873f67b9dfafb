"""Token ids of whole texts under a byte-level BPE file of the tokenizers library, with a cache of words."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

#: Words whose ids a worker remembers, and the longest (in characters) that it does.
REMEMBERED, LONGEST = 300_000, 64
#: A space after white space: such a text isn't cut at every space.
RUN = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S) ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others are numbered from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(path: str) -> Callable[[str], list[int]] | None:
    """The encoder of the faster tiktoken library for the same vocabulary, if the file is one that it can express.

    That is a plain byte-level BPE without a normalizer whose ids of two and more bytes are in the order of the merges,
    so that the least rank of a pair is the least id it merges to.
    """
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not file["normalizer"]
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    of = _bytes_of()
    added = {x["content"] for x in file["added_tokens"]}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merged = [model["vocab"]["".join(pair)] for pair in pairs]
    ranks = {bytes(of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}
    if merged != sorted(merged) or len(set(merged)) != len(merged) or len(merged) + 256 != len(ranks):
        return None
    import public_tokenizers
    import tiktoken

    pattern = public_tokenizers.PATTERN
    return tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _library(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return lambda text: found.encode(text, add_special_tokens=False).ids


def _added(path: str) -> re.Pattern | None:
    """Finds the file's added tokens, which the library looks for before all else; None if there are none."""
    contents = [x["content"] for x in json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]]
    return re.compile("|".join(map(re.escape, contents))) if contents else None


class Encoder:
    """The ids that ``encode(text, add_special_tokens=False)`` of the library gives, as little-endian unsigned 32-bit integers.

    The file's pattern never joins white space to what stands before it, so a text may be cut before any space that
    follows another character than white space, and the ids of the parts are those of the whole. A text that holds the
    string of an added token goes to the library whole, as the library takes such a string out before it looks for words.
    """

    def __init__(self, path: str):
        self._ids = _ranked(path) or _library(path)
        self._whole = _library(path)
        self._added = _added(path)
        self._spaced: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        ids = array("I", self._ids(text))
        return ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._spaced) > REMEMBERED:
            self._spaced.clear()
        known = self._spaced
        out = []
        for text in texts:
            if self._added and self._added.search(text):
                out.append(array("I", self._whole(text)).tobytes())
                continue
            first, *rest = CUT.split(text) if RUN.search(text) else text.split(" ")
            parts = list(map(known.get, rest))
            if None in parts:
                for i, word in enumerate(rest):
                    if parts[i] is None:
                        parts[i] = known.get(word) or self._direct(" " + word)
                        if len(word) <= LONGEST:
                            known[word] = parts[i]
            out.append(b"".join([self._direct(first), *parts]))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
