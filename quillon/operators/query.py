"""The query language.

word (or), +word (and), -word (not), 'a phrase' or "a phrase", word-with-signs (a phrase), table:word, table:'phrase',
table:+word, table:* (the table may be a free leaf), @n (only network n). A prefix counts only beside its word.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.text import tokens_of

OR, AND, NOT = "or", "and", "not"


@dataclass(frozen=True)
class Keyword:
    words: tuple[str, ...]
    group: str = OR
    table: str | None = None

    @property
    def phrase(self) -> bool:
        return len(self.words) > 1

    def __str__(self) -> str:
        text = f"'{' '.join(self.words)}'" if self.phrase else self.words[0]
        return f"{f'{self.table}:' if self.table else ''}{ {OR: '', AND: '+', NOT: '-'}[self.group]}{text}"


@dataclass(frozen=True)
class KeywordQuery:
    """keywords: or, then and, then not."""

    keywords: tuple[Keyword, ...]
    stars: frozenset[str] = frozenset()
    network: int | None = None

    @property
    def ranked(self) -> tuple[Keyword, ...]:
        return tuple(k for k in self.keywords if k.group != NOT)

    @property
    def excluded(self) -> tuple[Keyword, ...]:
        return tuple(k for k in self.keywords if k.group == NOT)

    def surviving(self, df: dict[Keyword, int], strict: bool = False) -> KeywordQuery | None:
        """Without ranked keywords of no row; None if none is left, or with strict if an and keyword goes."""
        kept = tuple(k for k in self.keywords if k.group == NOT or df.get(k, 0) > 0)
        lost_and = strict and any(k.group == AND and k not in kept for k in self.keywords)
        return None if lost_and or not any(k.group != NOT for k in kept) else replace(self, keywords=kept)

    def __str__(self) -> str:
        return " ".join([*(f"@{self.network}" for _ in (1,) if self.network is not None), *map(str, self.keywords), *(f"{t}:*" for t in sorted(self.stars))])


def parse(text: str) -> KeywordQuery | None:
    """None if a quote is open or no keyword is left."""
    found: list[Keyword] = []
    stars: set[str] = set()
    network = None
    s, i, n = text.replace('"', "'"), 0, len(text)
    while i < n:
        if s[i].isspace():
            i += 1
            continue
        group, table = OR, None
        while i < n and not s[i].isspace():
            if s[i] in "+-" and (i + 1 < n and not s[i + 1].isspace()):
                group = AND if s[i] == "+" else NOT
                i += 1
                continue
            if s[i] == "'":
                end = s.find("'", i + 1)
                if end < 0:
                    return None
                raw, i = s[i + 1 : end], end + 1
            else:
                end = i
                while end < n and not s[end].isspace() and s[end] not in ":'":
                    end += 1
                raw = s[i:end]
                if end < n and s[end] == ":" and raw and table is None and end + 1 < n and not s[end + 1].isspace():
                    table, i = raw, end + 1
                    continue
                i = max(end, i + 1)
                if raw.startswith("@") and raw[1:].isdigit():
                    network = int(raw[1:])
                    continue
                if raw == "*" and table:
                    stars.add(table)
                    continue
            if words := tuple(tokens_of(raw)):
                found.append(Keyword(words, group, table))
    unique = list(dict.fromkeys(found))
    ordered = tuple(k for g in (OR, AND, NOT) for k in unique if k.group == g)
    return KeywordQuery(ordered, frozenset(stars), network) if any(k.group != NOT for k in ordered) else None
