"""Schemas that can be searched: tables with keys and text columns, joined by foreign keys."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property


@dataclass(frozen=True)
class ForeignKey:
    """fk_table.fk_col refers to pk_table.pk_col."""

    pk_table: str
    pk_col: str
    fk_table: str
    fk_col: str


@dataclass(frozen=True)
class Table:
    """pk: key columns, none if the table has no key; row_id: columns that tell rows apart where it has none."""

    name: str
    pk: tuple[str, ...]
    text: tuple[str, ...] = ()
    row_id: tuple[str, ...] = ()

    @property
    def identity(self) -> tuple[str, ...]:
        return self.pk or self.row_id


@dataclass(frozen=True)
class SchemaSpec:
    name: str
    tables: tuple[Table, ...]
    fks: tuple[ForeignKey, ...] = field(default=())

    @cached_property
    def by_name(self) -> dict[str, Table]:
        return {t.name: t for t in self.tables}

    @cached_property
    def text_tables(self) -> tuple[str, ...]:
        return tuple(t.name for t in self.tables if t.text)

    def fk_columns(self, table: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f.fk_col for f in self.fks if f.fk_table == table))

    def pk_columns(self, table: str) -> tuple[str, ...]:
        """Columns of table that foreign keys refer to."""
        return tuple(dict.fromkeys(f.pk_col for f in self.fks if f.pk_table == table))

    def columns(self, table: str) -> tuple[str, ...]:
        """Identity and join columns."""
        return tuple(dict.fromkeys((*self.by_name[table].identity, *self.pk_columns(table), *self.fk_columns(table))))

    def __post_init__(self) -> None:
        names = {t.name for t in self.tables}
        for f in self.fks:
            if f.fk_table not in names or f.pk_table not in names:
                raise ValueError(f"unknown table in {f}")

    @staticmethod
    def from_json(text: str) -> SchemaSpec:
        """{"name": ..., "tables": [{"name", "pk", "text"?, "row_id"?}], "fks": [[pk_table, pk_col, fk_table, fk_col]]}."""
        d = json.loads(text)
        tables = tuple(Table(t["name"], tuple(t["pk"]), tuple(t.get("text", ())), tuple(t.get("row_id", ()))) for t in d["tables"])
        return SchemaSpec(d["name"], tables, tuple(ForeignKey(*f) for f in d.get("fks", ())))

    def to_json(self) -> str:
        tables = [{"name": t.name, "pk": t.pk, "text": t.text, "row_id": t.row_id} for t in self.tables]
        return json.dumps({"name": self.name, "tables": tables, "fks": [[f.pk_table, f.pk_col, f.fk_table, f.fk_col] for f in self.fks]})


SALES = SchemaSpec(
    "sales",
    (
        Table("region", ("r_regionkey",), ("r_name",)),
        Table("nation", ("n_nationkey",), ("n_name",)),
        Table("customer", ("c_custkey",), ("c_name", "c_mktsegment")),
        Table("supplier", ("s_suppkey",), ("s_name",)),
        Table("part", ("p_partkey",), ("p_name", "p_brand", "p_type")),
        Table("orders", ("o_orderkey",)),
        Table("lineitem", (), (), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
    ),
    (
        ForeignKey("region", "r_regionkey", "nation", "n_regionkey"),
        ForeignKey("nation", "n_nationkey", "customer", "c_nationkey"),
        ForeignKey("nation", "n_nationkey", "supplier", "s_nationkey"),
        ForeignKey("customer", "c_custkey", "orders", "o_custkey"),
        ForeignKey("orders", "o_orderkey", "lineitem", "l_orderkey"),
        ForeignKey("part", "p_partkey", "lineitem", "l_partkey"),
        ForeignKey("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    ),
)

FILMS = SchemaSpec(
    "films",
    (Table("film", ("id",), ("name", "description")), Table("genre", ("id",), ("name", "description")), Table("film_genre", ("id",))),
    (ForeignKey("film", "id", "film_genre", "film"), ForeignKey("genre", "id", "film_genre", "genre")),
)

BIBLIOGRAPHY = SchemaSpec(
    "bibliography",
    (
        Table("item", ("item_id",), ("title",)),
        Table("person", ("person_id",), ("name",)),
        Table("publisher", ("publisher_id",), ("name",)),
        Table("series", ("series_id",), ("title",)),
        Table("person_item", (), (), ("person_id", "item_id")),
        Table("cite", (), (), ("item_id", "reference")),
    ),
    (
        ForeignKey("item", "item_id", "item", "cross_ref"),
        ForeignKey("publisher", "publisher_id", "item", "publisher_id"),
        ForeignKey("series", "series_id", "item", "series_id"),
        ForeignKey("person", "person_id", "person_item", "person_id"),
        ForeignKey("item", "item_id", "person_item", "item_id"),
        ForeignKey("item", "item_id", "cite", "item_id"),
        ForeignKey("item", "item_id", "cite", "reference"),
    ),
)



def _schema(name: str, keys: str, text: str, rows: str, fks: str) -> SchemaSpec:
    """keys, text, rows: 'table column,column; ...' of key columns, text columns, and columns that tell rows of tables without a key apart; fks: 'table.column > table.column; ...', the referring table first."""
    parts = [{x.split()[0]: tuple(x.split()[1].split(",")) for x in lines.split(";") if x.strip()} for lines in (keys, text, rows)]
    tables = tuple(Table(t, parts[0].get(t, ()), parts[1].get(t, ()), parts[2].get(t, ())) for t in dict.fromkeys((*parts[0], *parts[2])))
    pairs = [[side.strip().split(".") for side in x.split(">")] for x in fks.split(";") if x.strip()]
    return SchemaSpec(name, tables, tuple(ForeignKey(pk[0], pk[1], fk[0], fk[1]) for fk, pk in pairs))


# Tables, keys, text columns and references of two published data sets.
IMDB = _schema(
    "imdb",
    "actorplay Id; actors Id; actresses Id; actressplay Id; directors Id; genres Id; movies Id",
    "actorplay Charactor; actors Name; actresses Name; actressplay Charactor; directors Name; genres Name; movies Name",
    "direct Director,Movie",
    """actorplay.Actor > actors.Id; actorplay.Movie > movies.Id; actressplay.Actress > actresses.Id; actressplay.Movie > movies.Id;
    direct.Director > directors.Id; direct.Movie > movies.Id; genres.Movie > movies.Id""",
)

MONDIAL = _schema(
    "Mondial",
    """borders ID_COUNTRY1,ID_COUNTRY2; city ID; continent ID; country ID; desert ID; economy ID_COUNTRY; encompasses ID_CONTINENT,ID_COUNTRY; ethnic_group Name,ID_COUNTRY;
    geo_desert ID_PROVINCE,ID_DESERT; geo_island ID_PROVINCE,ID_ISLAND; geo_lake ID_PROVINCE,ID_LAKE; geo_mountain ID_PROVINCE,ID_MOUNTAIN; geo_river ID_PROVINCE,ID_RIVER; geo_sea ID_PROVINCE,ID_SEA;
    is_member ID_COUNTRY,ID_ORGANIZATION; island ID; lake ID; language Name,ID_COUNTRY; merges_with ID_SEA1,ID_SEA2; mountain ID; organization ID; politics ID_COUNTRY; population ID_COUNTRY; province ID;
    religion Name,ID_COUNTRY; river ID; sea ID""",
    """city Name; continent Name; country Code,Name; desert Name; ethnic_group Name; is_member Type; island Name,Islands; lake Name; language Name; mountain Name; organization Abbreviation,Name; politics Government;
    province Name; religion Name; river Name; sea Name""",
    "located ID_CITY,ID_RIVER,ID_LAKE,ID_SEA",
    """organization.ID_CITY > city.ID; is_member.ID_ORGANIZATION > organization.ID; is_member.ID_COUNTRY > country.ID; country.ID_CITY > city.ID; borders.ID_COUNTRY1 > country.ID; borders.ID_COUNTRY2 > country.ID;
    economy.ID_COUNTRY > country.ID; population.ID_COUNTRY > country.ID; politics.ID_COUNTRY > country.ID; located.ID_CITY > city.ID; located.ID_RIVER > river.ID; located.ID_LAKE > lake.ID; located.ID_SEA > sea.ID;
    city.ID_PROVINCE > province.ID; province.ID_COUNTRY > country.ID; province.ID_CITY > city.ID; language.ID_COUNTRY > country.ID; religion.ID_COUNTRY > country.ID; ethnic_group.ID_COUNTRY > country.ID;
    geo_lake.ID_LAKE > lake.ID; geo_lake.ID_PROVINCE > province.ID; geo_river.ID_RIVER > river.ID; geo_river.ID_PROVINCE > province.ID; geo_sea.ID_SEA > sea.ID; geo_sea.ID_PROVINCE > province.ID;
    geo_island.ID_ISLAND > island.ID; geo_island.ID_PROVINCE > province.ID; geo_mountain.ID_MOUNTAIN > mountain.ID; geo_mountain.ID_PROVINCE > province.ID; geo_desert.ID_DESERT > desert.ID; geo_desert.ID_PROVINCE > province.ID;
    encompasses.ID_COUNTRY > country.ID; encompasses.ID_CONTINENT > continent.ID; river.ID_LAKE > lake.ID; river.ID_SEA > sea.ID; river.ID_RIVER > river.ID; merges_with.ID_SEA1 > sea.ID; merges_with.ID_SEA2 > sea.ID""",
)

BUILT_IN = {s.name: s for s in (SALES, FILMS, BIBLIOGRAPHY, IMDB, MONDIAL)}
