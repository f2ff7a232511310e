"""GenBank records: the grammar of feature locations, and the genes and bases of a record."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"\s*(join|order|complement|one-of|\.\.|[\w.]+:|\d+|[(),.^<>])")


@dataclass(frozen=True)
class Exon:
    """A span of bases (start from 0) with its strand; ``remote`` names the sequence where that is another one."""

    start: int
    end: int
    ori: str
    remote: str | None = None


class _Location:
    """Recursive descent over the tokens of a location."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        body = text.rstrip()
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                raise self.wrong()
            self.tokens.append(m[1])
            at = m.end()

    def wrong(self) -> ValueError:
        return ValueError(f"not a location: {self.text}")

    def next(self) -> str:
        return self.tokens[0] if self.tokens else ""

    def take(self, *wanted: str) -> str:
        if not self.tokens or wanted and self.tokens[0] not in wanted:
            raise self.wrong()
        return self.tokens.pop(0)

    def location(self) -> list[Exon]:
        """Exons in the order in which they are read."""
        if self.next() == "complement":
            self.take()
            self.take("(")
            inner = self.location()
            self.take(")")
            return [Exon(e.start, e.end, "+" if e.ori == "-" else "-", e.remote) for e in reversed(inner)]
        if self.next() in ("join", "order"):
            self.take()
            return self.several(self.location)
        remote = self.take()[:-1] if self.next().endswith(":") else None
        first, last = self.position()
        if self.next() in ("..", "^"):
            self.take()
            last = self.position()[1]
        if not 1 <= first <= last:
            raise self.wrong()
        return [Exon(first - 1, last, "+", remote)]

    def several(self, one) -> list:
        self.take("(")
        out = list(one())
        while self.take(",", ")") == ",":
            out += one()
        return out

    def position(self) -> tuple[int, int]:
        """The least and the greatest base that a position may mean."""
        if self.next() == "one-of":
            self.take()
            places = self.several(lambda: [self.position()])
            return min(p[0] for p in places), max(p[1] for p in places)
        if self.next() == "(":
            self.take()
            low = self.number()
            self.take(".", "^")
            high = self.number()
            self.take(")")
            return low, high
        low = self.number()
        if self.next() == ".":  # one base somewhere between two
            self.take()
            return low, self.number()
        return low, low

    def number(self) -> int:
        if self.next() in ("<", ">"):
            self.take()
        if not self.next().isdigit():
            raise self.wrong()
        return int(self.take())


def exons(location: str) -> list[Exon]:
    """The exons of a location in the order in which they are read; ValueError if it does not follow the grammar."""
    parsed = _Location(location)
    out = parsed.location()
    if parsed.tokens:
        raise parsed.wrong()
    return out


def extent(found: list[Exon], length: int | None = None) -> tuple[int, int, str] | None:
    """Start (from 0), end and strand from the first base to the last; None if no exon lies on this sequence.

    Exons on other sequences are left out. Where one exon ends with the sequence (of ``length`` bases, else as far as any exon reaches) and the next begins with it, a circular
    sequence goes on: what follows is counted on from the end. All else is from the least base to the greatest, however the exons are ordered. The
    strand is that of the first exon.
    """
    own = [e for e in found if e.remote is None]
    if not own:
        return None
    top = length or max(e.end for e in own)
    for order in (own, own[::-1]):
        for k, (e, following) in enumerate(zip(order, order[1:])):
            if e.end == top and following.start == 0:
                return min(x.start for x in order[: k + 1]), top + max(x.end for x in order[k + 1 :]), own[0].ori
    return min(e.start for e in own), max(e.end for e in own), own[0].ori


def genbank_extent(location: str, length: int | None = None) -> tuple[int, int, str]:
    """Start, end and strand of a location's text; ValueError if no exon lies on this sequence."""
    place = extent(exons(location), length)
    if place is None:
        raise ValueError(f"no place on this sequence: {location}")
    return place


@dataclass(frozen=True)
class Gene:
    start: int
    end: int
    ori: str
    product: str
    protein_id: str
    protein: str
    exons: list[Exon]


def record_of(text: str) -> tuple[str, list[Gene], str] | None:
    """Name, genes (CDS features) and bases of a record; None for text without a LOCUS line."""
    head = re.search(r"(?m)^LOCUS\s+(\S+)(?:\s+(\d+)\s+bp)?", text)
    if not head:
        return None
    features, _, bases = text.partition("\nORIGIN")
    bases = re.sub(r"[^a-zA-Z]", "", bases)
    length = int(head[2]) if head[2] else len(bases) or None
    genes = []
    for m in re.finditer(r"(?m)^     CDS\s+(\S+(?:\n {21}[^/\s]\S*)*)((?:\n {21}.*)*)", features):
        notes = re.sub(r"\n {21}(?!/)", " ", m[2])
        marks = {k: v for k, v in re.findall(r'/(product|translation|protein_id)="([^"]*)"', notes)}
        place = re.sub(r"\s", "", m[1])
        genes.append(Gene(*genbank_extent(place, length), marks.get("product", "null"), marks.get("protein_id", f"{head[1]}_{len(genes)}"), marks.get("translation", "").replace(" ", ""), exons(place)))
    return head[1], genes, bases
