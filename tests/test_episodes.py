import pytest
from helpers import run_of, spans

from millrace.operators.episodes import episodes, evaluated_durations, region_end, whole_runs


@pytest.mark.parametrize(
    ("header", "options", "expected"),
    [
        ("FTTTF", {"grace_s": 2}, [(1, 4, 4)]),
        ("FTTFFTTF", {"grace_s": 1}, [(1, 3, 4), (5, 7, 7)]),
        ("TTTFFFF", {"grace_s": 2}, [(0, 3, 5)]),
        ("FFTTF", {"grace_s": 10}, [(2, 4, 4)]),
        ("FTFFTTF", {"min_duration_s": 1.5, "grace_s": 1}, [(4, 6, 6)]),
        ("FTTT", {"grace_s": 2}, [(1, 3, 3)]),
        # A run that begins On: later episodes take the start before theirs, unless asked not to.
        ("TTFTTF", {"grace_s": 0}, [(0, 2, 2), (0, 5, 5)]),
        ("TTFTTF", {"grace_s": 0, "fix_leading_on": True}, [(0, 2, 2), (3, 5, 5)]),
        ("TFTFTF", {"grace_s": 0}, [(0, 1, 1), (0, 3, 3), (2, 5, 5)]),
        ("FFFF", {}, []),
    ],
)
def test_episodes(spark, header, options, expected):
    found = episodes(run_of(spark, header=[c == "T" for c in header]), **options)
    assert [(r["start_time"], r["end_time"], r["extended_end_time"]) for r in found.orderBy("episode_ix").collect()] == expected


def test_runs_stay_apart_and_durations_add_up(spark):
    both = run_of(spark, "a", header=[False, True, True, False]).unionByName(run_of(spark, "b", header=[True, True, False, True, True]))
    found = episodes(both, grace_s=1)
    assert spans(found, "run_name", "episode_ix", "start_time", "end_time") == [("a", 0, 1, 3), ("b", 0, 0, 2), ("b", 1, 0, 4)]
    assert {r["run_name"]: r["evaluated_duration_s"] for r in evaluated_durations(found).collect()} == {"a": 2.0, "b": 6.0}
    assert spans(whole_runs(both), "run_name", "start_time", "end_time") == [("a", 0, 3), ("b", 0, 4)]


def test_errors(spark):
    with pytest.raises(ValueError, match="No header channel"):
        episodes(run_of(spark, header=[True]).drop("HeaderOn"))
    with pytest.raises(ValueError, match="region"):
        region_end("all")
