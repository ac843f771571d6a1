import pytest

pytest.importorskip("vecspark.llm")
