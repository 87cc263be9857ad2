"""Chat formatting: parts go by place, whatever the turns' numbers; crowded groups are cut further without another result."""

import random

import pytest

from quarry.llm import chat
from tests.compare import same

SCHEMA = "conv_id long, turn long, role string, text string"


def written(spark, folder, turns):
    frame = spark.createDataFrame(turns, SCHEMA)
    frame.write.parquet(f"{folder}/conversations.parquet")
    return frame


@pytest.mark.parametrize("numbers", [range(600), range(1, 601), range(0, 600000, 1000), [-7 * i for i in range(600, 0, -1)], [None, *range(599)]])
def test_any_numbering_gives_the_same_text(spark, numbers):
    turns = [(5, n, "user", f"turn {i}") for i, n in enumerate(numbers)]
    random.Random(1).shuffle(turns)
    rows = sorted(chat.formatted(spark.createDataFrame(turns, SCHEMA)).collect(), key=lambda r: r.part)
    assert [(r.part, r.part_turns, r.n_turns) for r in rows] == [(0, 256, 600), (1, 256, 600), (2, 88, 600)]
    assert "".join(r.text for r in rows) == "".join(f"<|im_start|>user\nturn {i}<|im_end|>\n" for i in range(600))


@pytest.mark.parametrize("most", [1 << 16, 40])
def test_sparse_repeated_and_null_against_sql(spark, tmp_path, most):
    """Sparse, negative, repeated and null numbers, snapshots of conversations over 256 turns, a crowd under a null id."""
    turns = [(8, 0, "u", "a"), (8, 1000, "u", "b"), (8, 2000, "u", "c"), (9, 0, "u", "a"), (9, 1, "u", "b"), (9, 100000, "u", "c"), (9, -5000, "x", "y"), (1, 5, "u", "a"), (2, None, None, None), (3, 4, "", "")]
    turns += [(c, 1 + i * 50, "user", f"turn {i}") for c, n in ((10, 3000), (11, 300), (12, 256), (13, 3000)) for i in range(n)] + [(None, i % 7, "user", f"u{i % 50}") for i in range(2500)]
    frame = written(spark, tmp_path, turns)
    got = chat.formatted(frame, most=most)
    same(got, chat.ORACLE_SQL, str(tmp_path))
    assert {r.conv_id for r in got.select("conv_id").distinct().collect()} == {2, 3, 8, 9, 10, None}
