"""Table specifications: columns with types, mapping strategies, keys and partitions; their validation and evolution."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T


class BadSchema(ValueError):
    """The specification breaks a rule."""


#: Declared types.
TYPES = {"String": T.StringType(), "Integer": T.LongType(), "Date": T.DateType(), "DateTime": T.TimestampType(), "Boolean": T.BooleanType(), "JSON": T.StringType()}
#: Strategies for turning source values into columns.
STRATEGIES = (
    "BoolDirect", "IntToBoolDirect", "IntDirect", "StringToIntDirect", "IntBSI", "FloatScaleBSI", "StringEnum", "StringHashBSI", "BoolRegex", "SysMillisBSI", "SysMicroBSI", "SysSecBSI", "UUIDBSI",
    "ParentRelation", "ChildRelation", "Custom", "CustomBSI", "IntLinear", "IntBuckets", "FloatLinear", "FloatBuckets", "YearToDay", "YearToMonth", "Year", "DayOfYear", "DayOfMonth", "DayOfWeek",
    "TimeOfDay", "HourOfDay", "Contains", "TimestampBSI", "StringBSI",
)
_DEFAULT_STRATEGY = {"String": "StringHashBSI", "Integer": "IntBSI", "Float": "FloatScaleBSI", "Date": "SysMicroBSI", "DateTime": "SysMicroBSI", "Boolean": "BoolDirect", "JSON": "StringHashBSI"}


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "String"
    strategy: str = ""
    source: str = ""
    foreign_key: str = ""
    scale: int = 2
    low: float | None = None
    high: float | None = None
    required: bool = False
    searchable: bool = False
    default: object = None
    multi: bool = False  # keeps several values at once
    description: str = ""
    options: tuple[tuple[str, object], ...] = ()

    @property
    def mapper(self) -> str:
        return self.strategy or _DEFAULT_STRATEGY.get(self.type, "StringHashBSI")

    @property
    def delimiter(self) -> str | None:
        return dict(self.options).get("delim")

    @property
    def spark_type(self) -> T.DataType:
        if self.type == "Float":
            return T.DecimalType(18, self.scale)
        base = TYPES[self.type]
        return T.ArrayType(base) if self.delimiter or self.multi else base


@dataclass(frozen=True)
class TableSpec:
    name: str
    attributes: tuple[Attribute, ...]
    primary_key: tuple[str, ...]
    secondary_keys: tuple[tuple[str, ...], ...] = ()
    quantum_field: str = ""
    quantum: str = ""  # YMD or YMDH
    selector: str = ""
    default_predicate: str = ""
    view_of: str = ""
    buckets: int = 8  # of a table without partitions by time; grows with the table
    folder: str = "data"  # of the table's own, that its rows are in

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name.lower() == name.lower()), None)

    @property
    def key(self) -> tuple[str, ...]:
        """The primary key; a partitioned table's begins with its time."""
        return self.primary_key if not self.quantum_field or self.quantum_field in self.primary_key else (self.quantum_field, *self.primary_key)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, a.spark_type, True, {"multi": a.multi} if a.multi else {}) for a in self.attributes])

    @classmethod
    def from_dict(cls, d: dict) -> TableSpec:
        attributes = []
        for a in d.get("attributes", []):
            name = a.get("fieldName") or a.get("sourceName", "").strip("/").split("/")[-1]
            attributes.append(
                Attribute(
                    name=name, type=a.get("type", "String"), strategy=a.get("mappingStrategy", ""), source=str(a.get("sourceName", "") or ""), foreign_key=a.get("foreignKey", ""), scale=int(a.get("scale", 2 if a.get("type") == "Float" else 0)),
                    low=a.get("minValue"), high=a.get("maxValue"), required=bool(a.get("required", False)), searchable=bool(a.get("searchable", False)), default=a.get("defaultValue"), multi=bool(a.get("nonExclusive", False)),
                    description=a.get("desc", ""), options=tuple(sorted((a.get("configuration") or {}).items())),
                )
            )
        keys = tuple(k.strip() for k in str(d.get("primaryKey", "")).split("+") if k.strip())
        second = tuple(tuple(p.strip() for p in k.split("+")) for k in str(d.get("secondaryKeys", "") or "").split(",") if k.strip())
        return cls(d.get("tableName", ""), tuple(attributes), keys, second, d.get("timeQuantumField", "") or "", d.get("timeQuantumType", "") or "", d.get("selector", "") or "", d.get("defaultPredicate", "") or "", d.get("isViewOf", "") or "", int(d.get("buckets", 8))).validate()

    @classmethod
    def from_yaml(cls, text: str) -> TableSpec:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; from_dict doesn't") from e
        return cls.from_dict(yaml.safe_load(text))

    def validate(self) -> TableSpec:
        if not self.name:
            raise BadSchema("a table needs a name")
        names = [a.name.lower() for a in self.attributes]
        if len(set(names)) < len(names):
            raise BadSchema(f"{self.name}: a column is named twice")
        if not self.primary_key and not self.view_of:
            raise BadSchema(f"{self.name}: a primary key is needed")
        for k in (*self.primary_key, *(x for s in self.secondary_keys for x in s)):
            if self.attribute(k) is None:
                raise BadSchema(f"{self.name}: key column {k} does not exist")
        for a in self.attributes:
            if a.type not in TYPES and a.type != "Float":
                raise BadSchema(f"{self.name}.{a.name}: unknown type {a.type}")
            if a.mapper not in STRATEGIES:
                raise BadSchema(f"{self.name}.{a.name}: unknown strategy {a.mapper}")
        if self.quantum:
            if self.quantum not in ("YMD", "YMDH"):
                raise BadSchema(f"{self.name}: the quantum is YMD or YMDH")
            q = self.attribute(self.quantum_field)
            if q is None or q.type not in ("Date", "DateTime"):
                raise BadSchema(f"{self.name}: a partitioned table needs a Date or DateTime field for its quantum")
        return self

    def compare(self, new: TableSpec) -> list[str]:
        """What changes from this specification to the new one; raises if the change is not allowed."""
        if (self.primary_key, self.secondary_keys, self.quantum_field, self.quantum) != (new.primary_key, new.secondary_keys, new.quantum_field, new.quantum):
            raise BadSchema(f"{self.name}: keys and partitions cannot change")
        changes = []
        for a in self.attributes:
            b = new.attribute(a.name)
            if b is None:
                raise BadSchema(f"{self.name}: column {a.name} cannot be dropped")
            for what in ("type", "foreign_key", "mapper", "scale", "low", "high", "searchable", "required", "multi"):
                if getattr(a, what) != getattr(b, what):
                    raise BadSchema(f"{self.name}.{a.name}: {what} cannot change")
            changes += [f"{a.name}: {what}" for what in ("source", "description", "default") if getattr(a, what) != getattr(b, what)]
        changes += [f"{b.name}: added" for b in new.attributes if self.attribute(b.name) is None]
        if self.selector != new.selector:
            changes.append("selector")
        return changes

    def with_column(self, a: Attribute) -> TableSpec:
        return replace(self, attributes=(*self.attributes, a)).validate()


