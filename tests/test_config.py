from dataclasses import dataclass, field

import pytest
from terrane.sources.config import build, parse, read_config


@dataclass(frozen=True)
class Inner:
    rate: float = 0.5
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outer:
    path: str
    n: int = 3
    on: bool = True
    inner: Inner = field(default_factory=Inner)


def test_sections_defaults_and_kinds(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# what it is\npath: a\ninner:\n  rate: 1\n  names: [x, y]\n")
    assert read_config(spark, str(tmp_path / "c.yaml"), Outer, {"n": 7, "path": None}) == Outer("a", 7, True, Inner(1.0, ("x", "y")))
    (tmp_path / "c.json").write_text('{"path": "a", "on": false}')
    assert read_config(spark, str(tmp_path / "c.json"), Outer) == Outer("a", on=False)


@pytest.mark.parametrize("values, said", [
    ({}, "missing path"), ({"path": "a", "m": 1}, "unknown m"), ({"path": 1}, "path: str is expected"), ({"path": "a", "n": True}, "n: int"), ({"path": "a", "n": 1.5}, "n: int"),
    ({"path": "a", "inner": {"rates": 1}}, "inner: unknown rates"), ({"path": "a", "inner": {"names": "x"}}, "inner.names: a list"), ({"path": "a", "inner": {"names": ["x", 1]}}, r"inner.names\[1\]"), ({"path": "a", "inner": 3}, "inner: a mapping"),
])
def test_errors_name_their_place(values, said):
    with pytest.raises(ValueError, match=said):
        build(Outer, values)


def test_texts():
    assert parse("") == {} and parse("a: 1") == {"a": 1}
    with pytest.raises(ValueError, match="mapping"):
        parse("[1]")
