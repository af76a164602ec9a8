"""All tests can be collected together: no two files of the same name, all importable."""

import collections
import os


def test_names_of_test_files_are_unique():
    here = os.path.dirname(os.path.abspath(__file__))
    names = collections.Counter(f for _, _, files in os.walk(here) for f in files if f.startswith("test_") and f.endswith(".py"))
    assert max(names.values()) == 1


def test_every_query_is_callable_and_oracles_are_of_queries():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert all(callable(f) for f in found.values()) and set(__spark_entry__.oracle_sql()) <= set(found)
