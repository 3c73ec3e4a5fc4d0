"""The catalog of typed tables: system -> database -> schema -> table -> field, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import types as T

from ..errors import AnalysisError

TYPES = {"boolean": T.BooleanType(), "float64": T.DoubleType(), "integer64": T.LongType(), "text": T.StringType(), "timestamp": T.StringType()}
USAGES = ("data", "time", "group", "sequence")


@dataclass
class Field:
    name: str
    type: str = "text"
    usage: str = "data"
    description: str = ""
    id: int = 0
    properties: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.type not in TYPES:
            raise AnalysisError(f"field {self.name}: unknown type {self.type}")
        if self.usage not in USAGES:
            raise AnalysisError(f"field {self.name}: unknown usage {self.usage}")


@dataclass
class Table:
    name: str
    fields: list[Field]
    id: int = 0
    description: str = ""

    def schema(self) -> T.StructType:
        """The fields in order, with usage and description as metadata."""
        return T.StructType([T.StructField(f.name, TYPES[f.type], True, {"usage": f.usage, "description": f.description, "type": f.type}) for f in self.fields])

    def template(self, separator: str = "|") -> str:
        """Two comment lines, names and types: the head of a delimited file for this table."""
        return "".join(separator.join(["#", *row]) + "\n" for row in ([f.name for f in self.fields], [f.type for f in self.fields]))


@dataclass
class Catalog:
    """One system; tables are named system.database.schema.table."""

    name: str
    tables: dict[str, Table]
    raw: dict

    @classmethod
    def from_json(cls, source: str | Path | dict) -> "Catalog":
        raw = source if isinstance(source, dict) else json.loads(Path(source).read_text() if isinstance(source, Path) or not str(source).lstrip().startswith("{") else source)
        tables = {}
        for d in raw.get("databases", []):
            for s in d.get("schemas", []):
                for t in s.get("tables", []):
                    fields = [Field(**{k: v for k, v in f.items() if k in Field.__dataclass_fields__}) for f in t.get("fields", [])]
                    tables[".".join((raw["name"], d["name"], s["name"], t["name"]))] = Table(t["name"], fields, t.get("id", 0), t.get("description", ""))
        return cls(raw["name"], tables, raw)

    def to_json(self) -> str:
        out = {k: v for k, v in self.raw.items() if k != "databases"} | {"databases": []}
        for d in self.raw.get("databases", []):
            schemas = []
            for s in d.get("schemas", []):
                tables = []
                for t in s.get("tables", []):
                    own = self.tables[".".join((self.name, d["name"], s["name"], t["name"]))]
                    tables.append({k: v for k, v in t.items() if k != "fields"} | {"fields": [asdict(f) for f in own.fields]})
                schemas.append({k: v for k, v in s.items() if k != "tables"} | {"tables": tables})
            out["databases"].append({k: v for k, v in d.items() if k != "schemas"} | {"schemas": schemas})
        return json.dumps(out, indent=2)

    def table(self, name: str) -> Table:
        if name.count(".") != 3:
            raise AnalysisError(f"{name}: a table is named system.database.schema.table")
        if name not in self.tables:
            raise AnalysisError(f"no table {name}; there are {', '.join(sorted(self.tables))}")
        return self.tables[name]

    def write_templates(self, folder: str | Path) -> list[Path]:
        out = []
        for name, table in self.tables.items():
            path = Path(folder) / (name.replace(".", "_") + ".csv")
            path.write_text(table.template())
            out.append(path)
        return out
