"""Configurations in YAML, and who is asked for judgements."""

import pytest

from scriptorium.plans.config import load_config, read_yaml, settings_of
from scriptorium.sources import judgements

TEXT = """
# how to run
profile: radiology   # or general
thresholds:
  auto_add: 0.9
  review: .7
scan:
  overlap_days: 5
high_priority_venues: [tmi, "tpami", 'midl']
authors:
  - name: "Ada: Quill #1"
    topics: [vlm]
    auto_add_threshold: 0.5
  - name: K. Moss
    note: it's hers
empty:
flags:
- true
- ~
- 12
"""


def test_yaml(tmp_path):
    got = read_yaml(TEXT)
    assert got["authors"] == [{"name": "Ada: Quill #1", "topics": ["vlm"], "auto_add_threshold": 0.5}, {"name": "K. Moss", "note": "it's hers"}]
    assert got["flags"] == [True, None, 12] and got["empty"] is None and got["thresholds"]["review"] == 0.7
    (tmp_path / "c.yaml").write_text(TEXT)
    s = settings_of(load_config(tmp_path / "c.yaml"), got["authors"])
    assert (s.profile, s.auto_add, s.overlap_days, s.high_priority_venues) == ("radiology", 0.9, 5, ("tmi", "tpami", "midl"))
    assert read_yaml("# nothing") == {}
    with pytest.raises(ValueError, match="can't read"):
        read_yaml("a: 1\n - b")


def test_provider(monkeypatch):
    known = {"first": "FIRST_KEY_OF_TEST", "second": "SECOND_KEY_OF_TEST"}
    assert judgements.provider(known) is None
    monkeypatch.setenv("SECOND_KEY_OF_TEST", " k ")
    assert judgements.provider(known) == "second" and judgements.provider(known, "first") is None
    monkeypatch.setenv("FIRST_KEY_OF_TEST", "k")
    assert judgements.provider(known) == "first" and judgements.provider(known, "second") == "second"
