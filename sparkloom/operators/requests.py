"""Requests for images in plain words.

A request is read as a list of tokens: numbers, words (host names and hyphenated names are one), and marks. Rules walk over
it, each taking the tokens that it understands: sides (`640x480`, `800 px`), a licence (`cc-by only`), hosts, and how
many. What none has taken says what the pictures should show. Anything that a request can't ask for in words is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..plans.errors import ParameterError

#: What pictures are called, and the words by which one asks for some.
PICTURES = frozenset("image images photo photos photograph photographs picture pictures".split())
ASKING = frozenset("find get collect acquire want need download".split())
#: Words that may stand between a number and what it counts.
KINDS = frozenset(("usable", "accepted"))
UNITS = frozenset(("px", "pixel", "pixels"))
LICENCES = frozenset(("cc0", "cc-by", "cc-by-sa"))
#: Words that end what `pictures of` is followed by.
ENDS = frozenset(("include", "minimum", "least", "from"))
#: Words that say nothing about a picture.
EMPTY = PICTURES | ASKING | KINDS | UNITS | frozenset("me i please some the a an of with at least minimum min by from and or in on".split())
#: What is not to be had, by the words that ask for it, and the answer.
REFUSALS = (
    (frozenset("csv dataset datasets tabular audio video videos document documents pdf pdfs".split()), "only images are collected"),
    (frozenset("avoid exclude without except".split()), "exclusions can't be enforced"),
    (frozenset("license licence licenses licences copyright commercial".split()), "licences are a field of their own"),
)

_TOKEN = re.compile(r"(?P<number>\d[\d,]*)(?![a-z0-9.-]*[a-z0-9]\.[a-z])|(?P<word>[a-z0-9_](?:[a-z0-9_'.-]*[a-z0-9_'])?)|(?P<mark>[^\sa-z0-9_])")


@dataclass
class Token:
    kind: str
    text: str
    taken: bool = False

    @property
    def number(self) -> int | None:
        digits = self.text.replace(",", "")
        return int(digits) if self.kind == "number" and digits else None


@dataclass
class Request:
    tokens: list[Token]
    count: int | None = None
    sides: tuple[int, int] | None = None
    licenses: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, text: str) -> Request:
        """Sizes are parted first: 640x480 is a number, a word and a number; so is 800px a number and a word."""
        parted = re.sub(r"(\d)\s*[x×]\s*(?=\d)", r"\1 x ", text.lower())
        parted = re.sub(r"(\d)(px|pixels?)\b", r"\1 \2", parted)
        return cls([Token(m.lastgroup, m[0].rstrip(",") if m.lastgroup == "number" else m[0]) for m in _TOKEN.finditer(parted)])

    def at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else Token("end", "")

    def _take(self, *places: int) -> None:
        for i in places:
            self.tokens[i].taken = True

    def take_licences(self) -> None:
        for i, t in enumerate(self.tokens):
            if t.text in LICENCES and self.at(i + 1).text == "only":
                self.licenses = self.licenses or [t.text]
                self._take(i, i + 1)

    def refuse(self) -> None:
        said = [t.text for t in self.tokens if not t.taken]
        for words, why in REFUSALS:
            if not words.isdisjoint(said):
                raise ParameterError(why)
        if any(pair == ("public", "domain") for pair in zip(said, said[1:], strict=False)):
            raise ParameterError(REFUSALS[-1][1])

    def take_sides(self) -> None:
        for i, t in enumerate(self.tokens):
            if t.number is None or t.taken:
                continue
            if self.at(i + 1).text == "x" and (other := self.at(i + 2).number) is not None:
                self.sides = self.sides or (t.number, other)
                self._take(i, i + 1, i + 2)
            elif self.at(i + 1).text in UNITS:
                self.sides = self.sides or (t.number, t.number)
                self._take(i, i + 1)

    def take_hosts(self) -> None:
        for t in self.tokens:
            name, _, last = t.text.rpartition(".")
            if t.kind == "word" and name and len(last) > 1 and last.isalpha():
                self.domains.append(t.text)
                t.taken = True

    def take_count(self) -> None:
        """A number that counts pictures, else one that follows a word of asking (and `me`, `at least`)."""
        free = [i for i, t in enumerate(self.tokens) if t.number is not None and not t.taken]

        def counted(i: int) -> bool:
            while self.at(i + 1).text in KINDS:
                i += 1
            return self.at(i + 1).text in PICTURES

        def asked(i: int) -> bool:
            while self.at(i - 1).text == "me":
                i -= 1
            return self.at(i - 1).text in ASKING

        found = next((i for rule in (counted, asked) for i in free if rule(i)), None)
        if found is not None:
            self.count = self.tokens[found].number
            self._take(found)

    def topic(self) -> str:
        """What follows `pictures of` up to a mark or a word that leads to something else; else all words not taken."""
        for i, t in enumerate(self.tokens):
            if t.text in PICTURES and self.at(i + 1).text == "of":
                said = []
                for u in self.tokens[i + 2 :]:
                    if u.kind == "mark" or u.taken or u.text in ENDS:
                        break
                    said.append(u.text)
                while said and said[-1] in EMPTY:
                    said.pop()
                if said:
                    return " ".join(said)
        left = [t.text for t in self.tokens if t.kind == "word" and not t.taken and t.text not in EMPTY]
        return " ".join(dict.fromkeys(left))


def parse_request(prompt: str) -> dict:
    """count, min_width, min_height, licenses, domains and topic of a request for images.

    `cc0 only`, `cc-by only` and `cc-by-sa only` name licences; any other talk of them, exclusions and requests for
    anything but images are refused. Without a count it is 100, without a size 512 by 512; one size counts for both sides.
    """
    r = Request.read(prompt)
    if not r.tokens:
        raise ParameterError("the request is empty")
    r.take_licences()
    r.refuse()
    r.take_sides()
    r.take_hosts()
    r.take_count()
    width, height = r.sides or (512, 512)
    return {"count": 100 if r.count is None else r.count, "min_width": width, "min_height": height, "licenses": r.licenses, "domains": r.domains, "topic": r.topic()}
