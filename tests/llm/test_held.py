"""What a Python worker remembers from task to task."""
from reeltide.llm import common


def test_one_operator_at_a_time():
    """The same arguments are made once; asking another function, or forget, drops what was remembered."""
    made = []
    first = common.held(lambda path: made.append(("first", path)) or [path])
    second = common.held(lambda path: made.append(("second", path)) or [path])
    assert first("a") is first("a") and len(made) == 1
    second("a")
    assert first("a") == ["a"] and made == [("first", "a"), ("second", "a"), ("first", "a")]
    first("b")
    first("a")
    assert made[3:] == [("first", "b"), ("first", "a")]
    common.forget()
    common.forget()
    assert first("a") == ["a"] and made[5:] == [("first", "a")]
