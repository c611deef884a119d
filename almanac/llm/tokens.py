"""Edit-aware token counts.

A text is split into pre-tokens by the tokenizer's pattern; byte-pair merges
never cross them, so a text's token count is the sum over its pre-tokens. A
document keeps its pre-tokens in leaves of a segment tree that stores, for
every subtree, characters and tokens. An edit re-encodes only the pre-tokens
it touches, plus context: from a few characters to the left (the pattern
looks at most ``LOOKAHEAD`` characters ahead) to the first old boundary to the
right that the new split hits again. From there on the old pre-tokens stay
valid, because the pattern never looks back. Then the sums on the path to the
root are updated.

Edge cases: null and empty texts have 0 tokens; edits beyond the end are cut
to it; no edits leave the count as it is; edits apply one after the other, in
order; repeated rows are counted alike; other columns are ignored. Texts are
counted whole, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import map_batches, table

#: Vocabulary file of the registered query; any file of ranks will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)
#: Characters beyond a pre-token's end that can decide where it ends.
LOOKAHEAD = 3
LEAF = 64
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000


class Counter:
    """Token counts of pre-tokens under one vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, token: str) -> int:
        n = self.known.get(token)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[token] = len(self.encoding.encode_ordinary(token))
        return n

    def all(self, tokens: list[str]) -> list[int]:
        counts = list(map(self.known.get, tokens))
        return [self(t) if n is None else n for t, n in zip(tokens, counts, strict=True)] if None in counts else counts


@cache
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


#: A leaf: its text, and the characters and tokens of each pre-token in it.
Leaf = tuple[str, list[tuple[int, int]]]


def leaves_of(text: str, pairs: list[tuple[int, int]], per: int = LEAF) -> list[Leaf]:
    """Leaves of ``per`` pre-tokens, each with its part of the text."""
    out, at = [], 0
    for k in range(0, len(pairs), per):
        part = pairs[k : k + per]
        end = at + sum(c for c, _ in part)
        out.append((text[at:end], part))
        at = end
    return out


class CountedText:
    """A text, held in the leaves of a segment tree over its pre-tokens.

    An edit reads and writes the leaves that it touches and the path above
    them, so its cost does not grow with the text; only when a leaf has
    grown to ``4 * LEAF`` pre-tokens are large leaves split and the sums
    above all leaves made anew.
    """

    def __init__(self, text: str | None, count: Counter):
        self.count = count
        self.encoded = 0  # characters that edits made it encode anew
        self.start_with(text or "")

    def start_with(self, text: str) -> None:
        tokens = SPLIT.findall(text)
        self.build(leaves_of(text, list(zip(map(len, tokens), self.count.all(tokens), strict=True))))

    def build(self, leaves: list[Leaf]) -> None:
        self.leaves = leaves
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (text, pairs) in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = len(text), sum(n for _, n in pairs)
        for i in range(self.size - 1, 0, -1):
            self.pull(i)

    def pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(text for text, _ in self.leaves)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place``, and where the leaf starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if place >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def edit(self, start: int, removed: int, inserted: str) -> int:
        """Replace ``removed`` characters from ``start`` by ``inserted``; the new token count."""
        length = self.chars[1]
        start = max(0, min(start, length))
        end = min(length, start + max(0, removed))
        if not self.leaves:
            self.start_with(inserted)
            self.encoded += len(inserted)
            return self.total
        first, at = self.leaf_at(max(0, start - LOOKAHEAD - 1))
        while first and at > start - LOOKAHEAD:
            first -= 1
            at -= self.chars[self.size + first]
        kept, skip = at, 0
        for chars, _ in self.leaves[first][1]:
            if kept + chars > start - LOOKAHEAD:
                break
            kept, skip = kept + chars, skip + 1
        # The new text from ``kept`` on, as far as leaves up to ``read`` tell it.
        old, read = self.leaves[first][0][kept - at :], first
        while kept + len(old) < end:
            read += 1
            old += self.leaves[read][0]
        window, step = old[: start - kept] + inserted + old[end - kept :], 1
        shift = len(inserted) - (end - start)
        # Old boundaries at or after the edit's end, found as they are needed.
        last, i, place, leaf_start = first, skip, kept, at
        fresh: list[tuple[int, int]] = []
        position = kept
        while True:
            while place + shift < position or place < end:
                if i >= len(self.leaves[last][1]):
                    if last + 1 >= len(self.leaves):
                        break
                    leaf_start += self.chars[self.size + last]
                    last, i = last + 1, 0
                    continue
                place += self.leaves[last][1][i][0]
                i += 1
            if place >= end and place + shift == position:
                break
            m = SPLIT.match(window, position - kept)
            while (m is None or m.end() + LOOKAHEAD > len(window)) and read + 1 < len(self.leaves):
                window += "".join(text for text, _ in self.leaves[read + 1 : read + 1 + step])
                read, step = min(read + step, len(self.leaves) - 1), 2 * step
                m = SPLIT.match(window, position - kept)
            if m is None:
                break
            fresh.append((m.end() - m.start(), self.count(m.group())))
            self.encoded += m.end() - m.start()
            position = kept + m.end()
        text = self.leaves[first][0][: kept - at] + window[: position - kept] + self.leaves[last][0][place - leaf_start :]
        self.splice(first, last, text, self.leaves[first][1][:skip] + fresh + self.leaves[last][1][i:])
        return self.total

    def splice(self, first: int, last: int, text: str, pairs: list[tuple[int, int]]) -> None:
        """Put ``text`` and its pre-tokens in place of the leaves from ``first`` to ``last``."""
        n = last - first + 1
        if len(pairs) > 4 * LEAF * n:
            others = (part for leaf in self.leaves[:first] + [(text, pairs)] + self.leaves[last + 1 :] for part in (leaves_of(*leaf) if len(leaf[1]) > 2 * LEAF else [leaf]))
            self.build([leaf for leaf in others if leaf[0]])
            return
        parts = leaves_of(text, pairs, max(1, -(-len(pairs) // n)))
        for k in range(n):
            leaf = self.leaves[first + k] = parts[k] if k < len(parts) else ("", [])
            j = self.size + first + k
            self.chars[j], self.tokens[j] = len(leaf[0]), sum(t for _, t in leaf[1])
        lo, hi = (self.size + first) // 2, (self.size + last) // 2
        while lo:
            for j in range(lo, hi + 1):
                self.pull(j)
            lo, hi = lo // 2, hi // 2


Edits = Iterable[tuple[int, int, str]]

SPACES = regex.compile(r"[ \t]{2,}|\n{3,}|[ \t]+(?=\n)")
ADDRESS = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a typical clean-up, from the last to the first, so that places stay valid.

    Addresses become ``[email]``; runs of blanks become one, blanks before a line end go, and empty lines are thinned to one.
    """
    found = []
    if "@" in text:
        found = [(m.start(), len(m.group()), "[email]") for m in ADDRESS.finditer(text)]
    for m in SPACES.finditer(text):
        run = m.group()
        followed = m.end() < len(text) and text[m.end()] == "\n"
        found.append((m.start(), len(run), "\n\n" if run[0] == "\n" else "" if followed else " "))
    return sorted(found, reverse=True)


def count_edits(docs: DataFrame, edits: Callable[[str], Edits] = cleaning_edits, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_edits, n_tokens_after, n_encoded) with the tokens before and after each document's edits."""

    def run(batch: pa.RecordBatch) -> dict:
        count = counter(vocabulary)
        before, changes, after, encoded = [], [], [], []
        for text in batch.column("text").to_pylist():
            tree = CountedText(text, count)
            before.append(tree.total)
            n = 0
            for n, (start, removed, inserted) in enumerate(edits(text or ""), 1):  # noqa: B007
                tree.edit(start, removed, inserted)
            changes.append(n)
            after.append(tree.total)
            encoded.append(tree.encoded)
        return {key: batch.column(key), "n_tokens": before, "n_edits": changes, "n_tokens_after": after, "n_encoded": encoded}

    return map_batches(docs.select(F.col(key).cast("long").alias(key), "text"), run, f"{key} long, n_tokens long, n_edits long, n_tokens_after long, n_encoded long")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(table(spark, sf_dir, "documents"))
