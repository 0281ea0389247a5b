import pytest

from tagsieve.llm.confusables import look_alikes


@pytest.fixture(scope="session")
def alike(spark):
    return look_alikes(spark)
