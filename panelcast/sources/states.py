"""Fixed values about the fifty states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.sources.inline import broadcast_inline

# Name, postal code, electoral votes, class, battleground.
STATES = [
    ("Alabama", "AL", 9, "Red", False),
    ("Alaska", "AK", 3, "Red", False),
    ("Arizona", "AZ", 11, "Sun Swing", True),
    ("Arkansas", "AR", 6, "Red", False),
    ("California", "CA", 55, "Blue", False),
    ("Colorado", "CO", 9, "Blue", False),
    ("Connecticut", "CT", 7, "Blue", False),
    ("Delaware", "DE", 3, "Blue", False),
    ("Florida", "FL", 29, "Sun Swing", True),
    ("Georgia", "GA", 16, "Sun Swing", True),
    ("Hawaii", "HI", 4, "Blue", False),
    ("Idaho", "ID", 4, "Red", False),
    ("Illinois", "IL", 20, "Blue", False),
    ("Indiana", "IN", 11, "Red", False),
    ("Iowa", "IA", 6, "Swing", True),
    ("Kansas", "KS", 6, "Red", False),
    ("Kentucky", "KY", 8, "Red", False),
    ("Louisiana", "LA", 8, "Red", False),
    ("Maine", "ME", 4, "Blue", False),
    ("Maryland", "MD", 10, "Blue", False),
    ("Massachusetts", "MA", 11, "Blue", False),
    ("Michigan", "MI", 16, "Swing", True),
    ("Minnesota", "MN", 10, "Blue", True),
    ("Mississippi", "MS", 6, "Red", False),
    ("Missouri", "MO", 10, "Red", False),
    ("Montana", "MT", 3, "Red", False),
    ("Nebraska", "NE", 5, "Red", False),
    ("Nevada", "NV", 6, "Blue", True),
    ("New Hampshire", "NH", 4, "Swing", True),
    ("New Jersey", "NJ", 14, "Blue", False),
    ("New Mexico", "NM", 5, "Blue", False),
    ("New York", "NY", 29, "Blue", False),
    ("North Carolina", "NC", 15, "Sun Swing", True),
    ("North Dakota", "ND", 3, "Red", False),
    ("Ohio", "OH", 18, "Swing", True),
    ("Oklahoma", "OK", 7, "Red", False),
    ("Oregon", "OR", 7, "Blue", False),
    ("Pennsylvania", "PA", 20, "Swing", True),
    ("Rhode Island", "RI", 4, "Blue", False),
    ("South Carolina", "SC", 9, "Red", False),
    ("South Dakota", "SD", 3, "Red", False),
    ("Tennessee", "TN", 11, "Red", False),
    ("Texas", "TX", 38, "Sun Swing", True),
    ("Utah", "UT", 6, "Red", False),
    ("Vermont", "VT", 3, "Blue", False),
    ("Virginia", "VA", 13, "Blue", False),
    ("Washington", "WA", 12, "Blue", False),
    ("West Virginia", "WV", 5, "Red", False),
    ("Wisconsin", "WI", 10, "Swing", True),
    ("Wyoming", "WY", 3, "Red", False),
]

# Fixed value: the district votes outside the state table.
EXTERNAL_VOTES = ("D", 3)


def state_dimension(spark: SparkSession) -> DataFrame:
    """One row per state: name, code, votes, class, battleground flag."""
    schema = "unit STRING, code STRING, ev BIGINT, class STRING, is_battleground BOOLEAN"
    return broadcast_inline(spark, STATES, schema)
