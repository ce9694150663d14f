"""Token ids of whole texts, through a cache of words.

Both kinds of vocabulary split a text into words before they merge symbols, so the ids of a text are the ids of its
words in a row. Each distinct word is encoded once by the tokenizer and kept as bytes (little-endian unsigned 32-bit
ids). Texts in Latin letters are cut into words by the tokenizers' own pattern; other texts, and those with special
tokens, only at white space where a cut is certain; the rest is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import CACHES, keep_only

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: New words that a worker keeps before the older ones are let go, and the longest that is kept.
CACHE, LONGEST = 260_000, 256
# The letters and digits below U+0250, and the tokenizers' word patterns for them.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = {
    "byte": re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'(?:[sS]|[tT]|[rR][eE]|[vV][eE]|[mM]|[lL][lL]|[dD])|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"),
}
#: What these patterns may not be used for: other scripts, also in lower case (as U+0130 and U+0181 are), and odd white space.
_BEYOND = re.compile(f"[\x1c-\x1f\x85\xa0{''.join(c for c in map(chr, range(0x250)) if max(c.lower()) > 'ɏ')}\u0250-\U0010ffff]")
#: All else, of which words may consist; some as words; and what none has.
_PLAIN = [c for c in map(chr, range(0x250)) if not _BEYOND.match(c)]
_PROBE, _BETWEEN = [c for c in _PLAIN if not c.isspace()] + ["Word", "o\xeb\u0175"], "\uffff"
#: A space next to other white space: byte-level pieces then depend on the run.
_RUN = re.compile(r"\s | \s|^ | $")
#: A lone space between two visible characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Python splits at these, tokenizers do not.
_ODD = re.compile("[\x1c-\x1f]")
_LOADED: dict[str, Encoder] = {}
CACHES["tokens"] = _LOADED.clear


class Encoder:
    """`encode(texts)` gives each text's ids as little-endian unsigned 32-bit integers.

    kind "byte": byte-level BPE with a leading space in words; kind "word": BPE that drops white space; any other kind
    encodes whole texts.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Words are bytes to the model, each written as one symbol.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.symbols = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _PLAIN}
        # A tokenizer that does more to a word than that is asked itself.
        probe, self.plain = [w.lower() for w in _PROBE] if kind == "word" else _PROBE, True
        self.plain = kind in _WORDS and self.words(probe) == self.whole(probe)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words as the patterns cut them: the tokenizer's model merges their symbols, and does not cut them again."""
        if not self.plain:
            return self.whole(words)
        symbols, tokenize = _BETWEEN.join(words).translate(self.symbols).split(_BETWEEN) if words else [], self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in symbols]

    def pieces(self, text: str) -> list[str]:
        """A text that the patterns may not cut, cut at white space."""
        if self.kind == "byte":
            parts = _CUT.split(text) if _RUN.search(text) else text.split(" ")
            return [parts[0], *[f" {p}" for p in parts[1:]]]
        if self.kind == "word" and not _ODD.search(text):
            return text.split()
        return [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        known = {text: i for i, text in reversed([*enumerate(texts)])}  # the first of equal texts
        # Vocabularies of kind "word" lower the case; doing so here makes fewer distinct words.
        cased = str.lower if self.kind == "word" else str
        # One look at the cache for each word; the places of words that it lacks are kept.
        rows, missing = {}, (set(), set())
        for i in sorted(known.values()):
            text = texts[i]
            plain = self.kind in _WORDS and "<|" not in text and not _BEYOND.search(text)
            words = _WORDS[self.kind].findall(cased(text)) if plain else self.pieces(text)
            ids = list(map(cache.get, words))
            holes = [k for k, x in enumerate(ids) if x is None] if None in ids else ()
            missing[plain].update([words[k] for k in holes])
            rows[i] = (words, ids, holes)
        long: list[str] = []
        for found, encode in zip(missing, (self.whole, self.words), strict=True):
            again = found & older.keys()
            cache.update((p, older[p]) for p in again)
            new = list(found - again)
            cache.update(zip(new, encode(new), strict=True))
            long += [p for p in new if len(p) > LONGEST]
        done = {}
        for i, (words, ids, holes) in rows.items():
            for k in holes:
                ids[k] = cache[words[k]]
            done[i] = b"".join(ids)
        for p in long:
            cache.pop(p, None)
        return [done[known[text]] for text in texts]


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process."""
    keep_only("tokens")
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, kind)
    return _LOADED[path]
