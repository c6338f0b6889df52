"""What a Python worker keeps between tasks."""

from routeloom.llm import common


def test_caches_end_with_their_operator():
    loads = []

    def load(name):
        loads.append(name)
        return name

    load.__module__ = "one"
    cached = common.task_cache(2)(load)
    try:
        for operator in ("one", "one", "two", "one"):
            common.begin(operator)
            if operator == "one":
                cached("a")
        assert loads == ["a", "a"]
    finally:
        common._CACHES.remove(cached)
