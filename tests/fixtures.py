"""Small invented inputs."""

from __future__ import annotations

from marginloom import schemas
from marginloom.plans.margins import Margins

REFERENCE = "2025-01-01"
PLACES = [("970012", "970", "97"), ("970045", "970", "97"), ("980003", "980", "98")]
# age -> males, females, foreign males, foreign females
AGES = {3: (2, 4, 1, 0), 16: (2, 1, 0, 1), 52: (5, 4, 1, 0), 100: (1, 1, 1, 1)}
SIZES = [0, 3, 0, 2, 0, 0]
COUNTRIES = {"100": [7, 8], "436": [1, 1], "999": [2, 1]}


def documents(spark, places=PLACES, ages=AGES, sizes=SIZES, countries=COUNTRIES):
    def column(index):
        counts = [0] * 101
        for age, values in ages.items():
            counts[age] = values[index]
        return counts

    national = spark.createDataFrame(
        [(*p, column(0), column(1), list(sizes)) for p in places], schemas.NATIONAL_INPUT)
    citizenship = spark.createDataFrame(
        [(p[0], column(2), column(3), countries) for p in places], schemas.CITIZENSHIP_INPUT)
    return national, citizenship


def margins(spark, citizenship=True, **changes) -> Margins:
    national, extra = documents(spark, **changes)
    return Margins.from_documents(national, extra if citizenship else None)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
