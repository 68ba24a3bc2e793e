import json

from skeinwork.model import EVENTS
from skeinwork.operators import cards
from skeinwork.streaming.card_events import append_events, read_events


def test_events_reach_the_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    patches = [{"card_id": "a", "title": "t", "status": "Created", "at": "1", "seq": 1}, {"card_id": "a", "status": "Complete", "at": "2", "seq": 2}]
    for i, patch in enumerate(patches):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(patch))
        append_events(read_events(spark, str(tmp_path / "in")), str(tmp_path / "events"), str(tmp_path / "log")).awaitTermination(120)
    row = cards.current_state(spark.read.schema(EVENTS).parquet(str(tmp_path / "events"))).first()
    assert (row["title"], row["status"], row["created_at"], row["updated_at"]) == ("t", "Complete", "1", "2")
