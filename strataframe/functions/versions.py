"""Versions in the common Python notation (``1!2.0rc1.post2.dev3+local.4``): parsing and order."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import total_ordering

_FORM = re.compile(
    r"\s*v?(?:(?P<epoch>\d+)!)?(?P<release>\d+(?:\.\d+)*)"
    r"(?:[._-]?(?P<pre>alpha|a|beta|b|preview|pre|c|rc)[._-]?(?P<pre_n>\d+)?)?"
    r"(?P<post>-(?P<post_n>\d+)|[._-]?(?:post|rev|r)[._-]?(?P<post_m>\d+)?)?"
    r"(?P<dev>[._-]?dev[._-]?(?P<dev_n>\d+)?)?"
    r"(?:\+(?P<local>[a-z0-9]+(?:[._-][a-z0-9]+)*))?\s*",
    re.IGNORECASE,
)
_STAGES = {"alpha": "a", "beta": "b", "c": "rc", "pre": "rc", "preview": "rc"}


@total_ordering
@dataclass(frozen=True)
class Version:
    """Ordered as dev < a < b < rc < final < post; trailing zeros of a release don't count, a local part comes after none."""

    epoch: int
    release: tuple[int, ...]
    pre: tuple[str, int] | None
    post: int | None
    dev: int | None
    local: tuple[int | str, ...]

    @classmethod
    def parse(cls, text: str) -> Version:
        m = _FORM.fullmatch(text)
        if not m:
            raise ValueError(f"{text!r} is no version")
        stage = (m["pre"] or "").lower()
        local = re.split(r"[._-]", m["local"].lower()) if m["local"] else []
        return cls(
            int(m["epoch"] or 0),
            tuple(map(int, m["release"].split("."))),
            (_STAGES.get(stage, stage), int(m["pre_n"] or 0)) if stage else None,
            int(m["post_n"] or m["post_m"] or 0) if m["post"] else None,
            int(m["dev_n"] or 0) if m["dev"] else None,
            tuple(int(x) if x.isdigit() else x for x in local),
        )

    @property
    def public(self) -> str:
        pre = "".join(map(str, self.pre)) if self.pre else ""
        parts = [f"{self.epoch}!" if self.epoch else "", ".".join(map(str, self.release)), pre]
        return "".join([*parts, "" if self.post is None else f".post{self.post}", "" if self.dev is None else f".dev{self.dev}"])

    def __str__(self) -> str:
        return self.public + ("+" + ".".join(map(str, self.local)) if self.local else "")

    @property
    def is_prerelease(self) -> bool:
        return self.pre is not None or self.dev is not None

    def _order(self) -> tuple:
        release = list(self.release)
        while len(release) > 1 and release[-1] == 0:
            release.pop()
        bare_dev = self.pre is None and self.post is None and self.dev is not None
        stage = ("", 0) if bare_dev else self.pre or ("z", 0)
        local = tuple((1, x, "") if isinstance(x, int) else (0, 0, x) for x in self.local)
        return self.epoch, release, stage, -1 if self.post is None else self.post, (1, 0) if self.dev is None else (0, self.dev), local

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Version) and self._order() == other._order()

    def __lt__(self, other: Version) -> bool:
        return self._order() < other._order()

    def __hash__(self) -> int:
        return hash(str(self._order()))


#: Versions of this library whose repositories this one can't read, as [from, below) pairs.
INCOMPATIBLE: list[tuple[str, str]] = []


def can_read(written_by: str, incompatible: list[tuple[str, str]] = INCOMPATIBLE) -> bool:
    """Whether a repository that this version made can be read."""
    own = Version.parse(written_by)
    return not any(Version.parse(low) <= own < Version.parse(high) for low, high in incompatible)
