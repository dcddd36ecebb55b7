"""Token ids of texts by the ``tokenizers`` library, with a pre-token cache.

The library's pre-tokens are encoded one by one, so the ids of a text are the
ids of its pre-tokens one after another.  For tokenizers of the kind of
``word_bpe_49k.json`` (``pre_tokens_are_plain`` checks the file) and texts in
ASCII and Latin-1, the pre-tokens are found by the tokenizer's own split
pattern on the lower-cased text, and the library encodes each distinct
pre-token once per worker.  All other texts and tokenizers go through the
library whole.  The ids are the same either way.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

MAX_CACHED = 300_000         # pre-tokens held per worker; the cache starts anew beyond it
MAX_CACHED_LENGTH = 64       # longer ones are encoded each time they occur

# FIXED VALUES: the normaliser and split pattern that the fast path stands for.
PLAIN_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                     {"type": "Lowercase"}]
PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Printable ASCII, the six ASCII white-space characters and Latin-1 from NBSP's
# successor on: NFC keeps them, and each has a one-character lower case.
_PLAIN_TEXT = re.compile(r"[\t\n\x0b\f\r -~¡-ÿ]*\Z")
_LETTERS = "a-zªµºß-öø-ÿ"
_PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9²³¹¼½¾]|[^\\t\\n\\x0b\\f\\r {_LETTERS}0-9²³¹¼½¾]+")


def default_tokenizer() -> str:
    """Path of the public tokenizer the queries use; a parameter everywhere."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pre_tokens_are_plain(spec: dict) -> bool:
    """Does the tokenizer file say what the fast path assumes?"""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return ((spec.get("normalizer") or {}).get("normalizers") == PLAIN_NORMALIZERS
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": PLAIN_SPLIT}
            and pre[0]["behavior"] == "Removed" and pre[0]["invert"] is True
            and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
            and bool(spec["model"].get("end_of_word_suffix"))
            and all(t["content"].startswith("<|") for t in spec.get("added_tokens", [])))


class TextEncoder:
    """``encode(texts)`` returns for each text its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = pre_tokens_are_plain(spec)
        if self.plain:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            for token, i in vocab.items():
                self.ends[i] = token.endswith(spec["model"]["end_of_word_suffix"])
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, fresh: list[str]) -> None:
        """Ids of pre-tokens not yet known.  The last id of a letter run, and
        only that, ends a word, so many runs are encoded at once and cut there."""
        cache, runs = self.cache, []
        for p in fresh:
            if p.isalpha():
                runs.append(p)
            else:
                cache[p] = self._whole(p)
        for at in range(0, len(runs), 64):
            part = runs[at:at + 64]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part):
                cache.update((r, self._whole(r)) for r in part)
                continue
            raw, prev = ids.tobytes(), 0
            for run, cut in zip(part, cuts.tolist()):
                cache[run] = raw[prev:cut]
                prev = cut

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):      # in slices, so that the pieces of a large batch are not all held
            size, rows, fresh = 0, [], set()
            while at < len(texts) and size < 2_000_000:
                t = texts[at] or ""
                at += 1
                size += len(t)
                if self.plain and "<|" not in t and _PLAIN_TEXT.match(t):
                    rows.append(_PRE_TOKENS.findall(t.lower()))
                    fresh.update(rows[-1])
                else:
                    rows.append(t)
            known = self.cache
            fresh = {p for p in fresh if p not in known}
            if len(known) + len(fresh) > MAX_CACHED:
                self.cache = {}
                fresh = set().union(*(r for r in rows if isinstance(r, list)))
            self._learn(list(fresh))
            get = self.cache.__getitem__
            out += [b"".join(map(get, r)) if isinstance(r, list) else self._whole(r) for r in rows]
            for p in fresh:
                if len(p) > MAX_CACHED_LENGTH:
                    del self.cache[p]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker and tokenizer file."""
    return TextEncoder(path)
