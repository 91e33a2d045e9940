"""What a filter panel's choices keep."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import library as L

NOW = datetime(2024, 6, 30, 12)
KIND = "id int, status string, words long, duration_ms long, file int, audio string, voice string, speed double, made_at timestamp, step string"
ROWS = [
    (1, "done", 100, 60_000, 0, "a", "Ann", 1.0, NOW - timedelta(hours=3), "linked"), (2, "done", 0, 90_000, 1, "a", "Ann", 1.2, NOW - timedelta(days=7), "paired"), (3, "failed", 900, None, 1, "a", None, None, None, "pairing"),
    (4, "pending", 500, 60_000, None, None, "Ann", 1.0, NOW, "unpaired"), (5, "done", 700, 0, 0, "", "Bob", 1.0, NOW, None), (6, "done", 250, 200_000, 0, "a", "Bob", None, NOW - timedelta(days=31), "no-text"),
]


@pytest.mark.parametrize("choice, ids", [
    ({}, [1, 2, 3, 4, 5, 6]), ({"statuses": ["done", "failed"]}, [1, 2, 3, 5, 6]), ({"file": 1}, [2, 3]), ({"voice": "Ann"}, [1, 2]), ({"voice": L.STALE}, [2, 3, 6]), ({"step": "readable"}, [1, 2]), ({"step": "needs-pairing"}, [3, 4]),
    ({"step": "needs-words"}, [2]), ({"step": "needs-translation"}, [6]), ({"age": "day"}, [1]), ({"age": "week"}, [1]), ({"age": "older-week"}, [2, 6]), ({"age": "older-month"}, [6]), ({"words_max": "0"}, [2]), ({"words_min": "250,5"}, [3, 4, 5]),
    ({"words_min": "x", "words_max": "-1"}, [1, 2, 3, 4, 5, 6]), ({"minutes_max": "1.5"}, [1, 2]), ({"minutes_min": "0"}, [1, 2, 6]), ({"statuses": ["done"], "voice": "Bob", "minutes_min": "3"}, [6]),
])
def test_choices(spark, choice, ids):
    rows = spark.createDataFrame(ROWS, KIND)
    assert sorted(r["id"] for r in rows.where(L.chapter_filter(choice, F.lit(NOW), ("Ann", 1.0))).collect()) == ids


def test_filters_in_use_are_counted():
    assert L.active_filters({}) == 0 and L.active_filters({"words_min": "-1", "statuses": []}) == 0
    assert L.active_filters({"words_min": "0", "words_max": "9", "minutes_max": "1", "file": 0, "voice": "x", "age": "day", "step": "linked", "statuses": ["a"]}) == 7
