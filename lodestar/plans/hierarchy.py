"""The declared star: which attribute lives on which level of which dimension."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from lodestar.plans.model import PlanError


@dataclass(frozen=True)
class Attribute:
    name: str
    dimension: str
    level: str
    kind: str  # "int" or "text"
    compare: str = "value"  # "suffix": ranges compare the number at the end of the text


@dataclass(frozen=True)
class Level:
    table: str
    attribute: str
    foreign_key: str  # held by the level below


class Hierarchy:
    """Roots, their level paths from the base table upwards, and the attribute map."""

    def __init__(self, paths: dict[str, list[Level]], attributes: dict[str, Attribute], fact: dict):
        self.paths, self.attributes, self.fact = paths, attributes, fact

    @classmethod
    def load(cls, path: str | Path | None = None) -> "Hierarchy":
        doc = json.loads(Path(path or Path(__file__).parents[1] / "corpus" / "hierarchy.json").read_text())
        paths: dict[str, list[Level]] = {}
        attributes: dict[str, Attribute] = {}
        for root, body in doc["dimensions"].items():
            paths[root] = [Level(x["table"], x["attribute"], x["foreign_key"]) for x in body["levels"]]
            for name, spec in body["attributes"].items():
                attributes[name] = Attribute(name, root, spec["level"], spec["kind"], spec.get("compare", "value"))
        for name, kind in doc["fact"]["columns"].items():
            attributes[name] = Attribute(name, doc["fact"]["table"], doc["fact"]["table"], kind)
        return cls(paths, attributes, doc["fact"])

    def resolve(self, name: str) -> Attribute:
        found = self.attributes.get(name) or self.attributes.get(name.upper())
        if found is None:
            raise PlanError(f"unknown column {name!r}")
        return found

    def depth(self, attribute: str) -> int:
        """How many levels above the base table the attribute sits (0: on the base table)."""
        found = self.resolve(attribute)
        for at, level in enumerate(self.paths.get(found.dimension, []), start=1):
            if level.table == found.level:
                return at
        return 0

    def render(self) -> str:
        out = []
        for root, levels in self.paths.items():
            out.append(root)
            out += [f"{'  ' * at}-> {x.attribute}: {x.table} (by {x.foreign_key})" for at, x in enumerate(levels, 1)]
        out.append(self.fact["table"])
        out += [f"  -> {dim} (by {key})" for dim, key in self.fact["foreign_keys"].items()]
        return "\n".join(out)
