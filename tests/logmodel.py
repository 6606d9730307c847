"""A small model of a log: entries are made first, then rendered to lines, so that what a parser must find is known."""
from __future__ import annotations

import random
from dataclasses import dataclass, field

LEVELS = ["TRACE", "INFO", "WARN", "ERROR"]
OWNERS = ["harbour.crane.Lift", "harbour.pier.Mooring", "tide.Gauge", "Lamp", "wörld.Boje"]


@dataclass
class Entry:
    second: int
    level: str
    logger: str
    text: str
    more: list = field(default_factory=list)      # continuation lines
    stack: list = field(default_factory=list)     # stack lines
    tenant: str = ""
    app: str = ""

    @property
    def stamp(self):
        return f"2031-07-04 {self.second // 3600:02d}:{self.second // 60 % 60:02d}:{self.second % 60:02d},{self.second % 1000:03d}"

    def header(self, shape):
        if shape == "tid":
            return f"TID: [{self.tenant}] [{self.app}] [{self.stamp}]  {self.level} {{{self.logger}}} - {self.text}"
        if shape == "bracket":
            return f"[{self.stamp}] {self.level} {{{self.logger}}} - {self.text}"
        return f"{self.stamp} {self.level} [{self.logger}] - {self.text}"


def some_entry(rng: random.Random, second: int) -> Entry:
    e = Entry(second, rng.choice(LEVELS), rng.choice(OWNERS), f"load {rng.randrange(900)} tons", tenant=rng.choice(["", "7", "88"]),
              app=rng.choice(["", "quay"]))
    for _ in range(rng.choice([0, 0, 1, 3])):
        e.more.append(rng.choice([" berth free", "\tcargo list", "rope 12", "at.sea"]) + f" {rng.randrange(9)}")
    for _ in range(rng.choice([0, 0, 0, 2, 4])):
        e.stack.append(rng.choice(["\tat {o}.pull({o}.java:{n})", "Caused by: {o}Error: {n}", "  ... {n} more", "java.{o}: {n}",
                                   "    Suppressed: {o}"]).format(o="Winch", n=rng.randrange(1, 99)))
    return e


def some_log(rng: random.Random, size: int, shape: str | None = None):
    """(lines, {line number: entry}): lines before the first header, blank lines and body lines in any order."""
    lines, found = ["greeting without a header"] * rng.randrange(3), {}
    for second in range(size):
        e = some_entry(rng, second)
        lines.append(e.header(shape or rng.choice(["tid", "bracket", "basic"])))
        found[len(lines)] = e
        body = [("c", x) for x in e.more] + [("s", x) for x in e.stack] + [("b", rng.choice(["", "  ", "\t"]))] * rng.randrange(2)
        rng.shuffle(body)
        e.more, e.stack = [x for k, x in body if k == "c"], [x for k, x in body if k == "s"]
        lines += [x for _, x in body]
    return lines, found
