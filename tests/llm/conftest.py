import pytest

pytest.importorskip("keyquarry.llm")
