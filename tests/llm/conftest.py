import pytest


@pytest.fixture(scope="session", autouse=True)
def stored_tables_are_released(spark):
    yield
    from brindle.llm.scratch import release

    release(spark)
