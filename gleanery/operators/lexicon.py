"""A trie of words: finds many aliases in one reading of a text."""

from __future__ import annotations

import re
from collections.abc import Iterable

WORD = re.compile(r"\w+")
#: Letters whose lower case depends on their place or has another form.
SAME = (("ſ", "s"), ("ς", "σ"), ("µ", "μ"))


def folded(text: str) -> str:
    """The text in lower case, each character in its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for one, other in SAME:
        low = low.replace(one, other)
    return low


class WordTrie:
    """Aliases by their words and what stands between them.

    A node leads by (gap, word) to the next one; its ends are the aliases that stop there: number, name, and what these
    have before their first and behind their last word. A text's different words tell which first words to look for; the
    aliases of a first word are searched one by one if they are few, and together along the trie otherwise. A small
    lexicon is searched alias by alias alone.
    """

    FEW = 16

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.root: dict[str, dict] = {}
        self.held: dict[str, list[tuple[str, str]]] = {}  # names and aliases of each first word
        self.bare: list[tuple[str, str]] = []  # aliases without a word
        self.every = [(name, folded(alias)) for name, alias in entries]
        for number, (name, alias) in enumerate(self.every):
            words = list(WORD.finditer(alias))
            if not words:
                self.bare.append((name, alias))
                continue
            first = words[0].group()
            node, at = self.root.setdefault(first, {}), words[0].end()
            self.held.setdefault(first, []).append((name, alias))
            for m in words[1:]:
                node, at = node.setdefault((alias[at : m.start()], m.group()), {}), m.end()
            node.setdefault(None, []).append((number, name, alias[: words[0].start()], alias[at:]))

    def earliest(self, text: str) -> dict[str, int]:
        """Names that the text holds as whole words, each with its first place (from 0)."""
        found: dict[str, int] = {}
        text = folded(text)
        if len(self.every) <= self.FEW * self.FEW // 4:  # fewer searches than words
            self._search(found, text, self.every)
            return found
        for first in self.root.keys() & set(WORD.findall(text)):
            few = len(self.held[first]) <= self.FEW
            self._search(found, text, self.held[first]) if few else self._follow(found, text, first)
        self._search(found, text, self.bare)
        return found

    @staticmethod
    def _search(found: dict[str, int], text: str, aliases: list[tuple[str, str]]) -> None:
        for name, alias in aliases:
            at = text.find(alias)
            while at >= 0 and not _free(text, at, at + len(alias)):
                at = text.find(alias, at + 1)
            if at >= 0:
                found[name] = min(at, found.get(name, at))

    def _follow(self, found: dict[str, int], text: str, first: str) -> None:
        """Takes up the aliases that begin with a word, each at its first place."""
        met: set[int] = set()
        begin = text.find(first)
        while begin >= 0 and len(met) < len(self.held[first]):
            end = begin + len(first)
            node = self.root[first] if _free(text, begin, end) else None
            while node is not None:
                for number, name, lead, tail in node.get(None, ()):
                    at = begin - len(lead)
                    if number not in met and at >= 0 and text.startswith(lead, at) and text.startswith(tail, end) and _free(text, at, end + len(tail)):
                        met.add(number)
                        found[name] = min(at, found.get(name, at))
                m = WORD.search(text, end) if len(node) > (None in node) else None
                node, end = (node.get((text[end : m.start()], m.group())), m.end()) if m else (None, end)
            begin = text.find(first, begin + 1)


def _free(text: str, begin: int, end: int) -> bool:
    """Whether no word character stands right before or behind."""
    return not (begin and WORD.match(text[begin - 1])) and not WORD.match(text, end)
