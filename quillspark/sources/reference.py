"""Reference data of a user: countries, parts of plants, methods and other word lists, as tables.

A folder holds a CSV file for each kind, with a header: ``countries`` (name, hemisphere),
``synonyms`` (name, country), ``adjectives`` (form, countries; several with "; "), ``institutions``
(pattern, country), ``homonyms`` (country, needs, not_with), ``continents`` (name), ``regions``
(name), ``parts`` (word, singular, kind), ``methods`` (category, keyword) and ``hotspots`` (name).
Missing files are empty lists. The lists are small and are read to the driver, where they become
the arguments of the extraction operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import extraction as ex

from .files import files, read_delimited

#: Entries of a list at most: they become expressions.
MOST = 100_000


@dataclass
class Reference:
    lists: dict[str, list[dict[str, str]]] = field(default_factory=dict)

    def _of(self, kind: str, column: str, /, **where: str) -> list[str]:
        rows = [r for r in self.lists.get(kind, []) if all((r.get(k) or "") == v for k, v in where.items())]
        return list(dict.fromkeys(r[column] for r in rows if r.get(column)))

    def _map(self, kind: str, key: str, value: str) -> dict[str, str]:
        return {r[key]: r[value] for r in self.lists.get(kind, []) if r.get(key) and r.get(value)}

    def countries(self) -> list[str]:
        return self._of("countries", "name")

    def north(self) -> set[str]:
        return set(self._of("countries", "name", hemisphere="North"))

    def south(self) -> set[str]:
        return set(self._of("countries", "name", hemisphere="South"))

    def synonyms(self) -> dict[str, str]:
        return self._map("synonyms", "name", "country")

    def adjectives(self) -> dict[str, list[str]]:
        """The countries of each adjective; collective ones ("Multiple ... countries") stand for none."""
        split = {a: [c.strip() for c in to.split(";")] for a, to in self._map("adjectives", "form", "countries").items()}
        return {a: [c for c in cs if c and not c.startswith("Multiple") and not c.endswith("countries")] for a, cs in split.items()}

    def institutions(self) -> dict[str, str]:
        return self._map("institutions", "pattern", "country")

    def homonyms(self) -> list[ex.PlaceRule]:
        return [ex.PlaceRule(r["country"], r.get("needs") or "", r.get("not_with") or "") for r in self.lists.get("homonyms", []) if r.get("country")]

    def continents(self) -> list[str]:
        return self._of("continents", "name")

    def regions(self) -> list[str]:
        return self._of("regions", "name")

    def hotspots(self) -> list[str]:
        return self._of("hotspots", "name")

    def methods(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in self.lists.get("methods", []):
            out.setdefault(r["category"], []).append(r["keyword"])
        return out

    def parts(self, kind: str = "simple") -> list[str]:
        return self._of("parts", "word", kind=kind)

    def singulars(self) -> dict[str, str]:
        return self._map("parts", "word", "singular")

    def classification(self, spark: SparkSession) -> DataFrame:
        """country, hemisphere."""
        rows = [(r["name"], r.get("hemisphere")) for r in self.lists.get("countries", [])]
        return spark.createDataFrame(rows, "country string, hemisphere string")

    def country(self, c: Column) -> Column:
        """The canonical name of a country, or the title-cased input."""
        return ex.standard_country(c, self.countries(), self.synonyms())

    def part(self, c: Column) -> Column:
        """The singular of a part of a plant where that is a known word."""
        known = sorted({*self.parts(), *self.parts("compound"), *self.singulars().values()})
        one = ex.singular(c, self.singulars())
        return F.when(one.isin(*known), one).otherwise(c)

    def unclassified(self, df: DataFrame, country: str) -> DataFrame:
        """The distinct standardised names that the classification hasn't."""
        return df.select(self.country(F.col(country)).alias("country")).distinct().where(~F.col("country").isin(*self.countries()))


KINDS = ("countries", "synonyms", "adjectives", "institutions", "homonyms", "continents", "regions", "parts", "methods", "hotspots")


def read(spark: SparkSession, folder: str) -> Reference:
    """The lists of a folder; ``kind.csv`` may be a file or a folder of files."""
    out = {}
    for kind in KINDS:
        for pattern in (f"{folder}/{kind}.csv", f"{folder}/{kind}.csv/part-*"):
            found = files(spark, pattern)
            if found and not any(p.endswith(".csv") and files(spark, f"{p}/part-*") for p in found):
                rows = read_delimited(spark, pattern).limit(MOST + 1).collect()
                if len(rows) > MOST:
                    raise ValueError(f"{kind} has more than {MOST} entries; join it as a table instead")
                out[kind] = [r.asDict() for r in rows]
    return Reference(out)
