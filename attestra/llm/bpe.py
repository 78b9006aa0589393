"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words whose counts a worker keeps; the memory is cleared beyond.
REMEMBERED = 300_000


class Counter:
    """Counts tokens of a word-level BPE vocabulary file (lower case, word ends, white space dropped)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the vocabulary's white space is Unicode's, without the four separator controls
        self.words = regex.compile(split["pattern"]["Regex"].replace("[^\\s", "[^\\p{White_Space}")).findall
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.known: dict[str, int] = {}
        self.remembered = remembered
        self.letters = _byte_letters()

    def merged(self, word: str) -> int:
        """Initial symbols minus merges: the lowest-ranked adjacent pair goes first, then the leftmost."""
        letters = self.letters
        syms: list[str | None] = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(syms)
        if not n:
            return 0
        syms[-1] += self.suffix
        ranks = self.ranks
        heap = [(r, i, syms[i], syms[i + 1]) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if syms[i] is not None else n
            if j >= n or syms[i] != a or syms[j] != b:
                continue
            both = a + b
            syms[i], syms[j] = both, None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((both, syms[k]))) is not None:
                    heapq.heappush(heap, (r, i, both, syms[k]))
            p = before[i]
            if p >= 0 and (r := ranks.get((syms[p], both))) is not None:
                heapq.heappush(heap, (r, p, syms[p], both))
        return left

    def chunk(self, chunk: str) -> int:
        """Tokens of a run without white space."""
        return sum(map(self.merged, self.words(chunk)))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = text.replace("Σ", "σ")  # each letter is lowered by itself
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.chunk(text)
        known, total = self.known, 0
        for w in text.split():
            try:
                total += known[w]
            except KeyError:
                if len(w) > 64:
                    total += self.chunk(w)
                    continue
                if len(known) >= self.remembered:
                    known.clear()
                known[w] = c = self.chunk(w)
                total += c
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a text; each special string in it is one. Null counts as empty."""
        if not text:
            return 0
        if self.specials is None or "<|" not in text and not self.specials.search(text):
            return self.plain(text)
        pieces = self.specials.split(text)
        return len(pieces) - 1 + sum(map(self.plain, pieces))


def _byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(spare)) for b in range(256)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per Python worker and vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def with_token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """docs plus n_bytes, n_tokens, over_limit; path names a vocabulary file that every worker can open.

    Null texts count as empty. Repeated rows stay, each with its counts; an empty table stays empty. Columns of docs with
    those names are replaced.
    """

    @F.pandas_udf("long")
    def tokens(text):
        import pandas as pd

        count = counter(path).count
        return pd.Series([count(t) for t in text], dtype="int64")

    out = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("n_tokens", tokens(F.col("text")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
