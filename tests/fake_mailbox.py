"""A mailbox for tests: threads from a JSON file; each search leaves a note in a folder."""

import json
import uuid
from datetime import UTC, datetime
from pathlib import Path


class Fake:
    def __init__(self, options):
        self.root = Path(options["root"])

    def search(self, query, page, size):
        (self.root / "asked").mkdir(exist_ok=True)
        (self.root / "asked" / uuid.uuid4().hex).write_text(json.dumps([page, size, str(query.newer), query.unread, list(query.domains)]))
        threads = json.loads((self.root / "threads.json").read_text())
        for t in threads:
            for m in t["messages"]:
                m["received_at"] = datetime.fromtimestamp(m["received_at"], UTC)
        fit = [t for t in threads if any(query.fits(m) for m in t["messages"])]
        return sorted(fit, key=lambda t: max(m["received_at"] for m in t["messages"]), reverse=True)[page * size : (page + 1) * size]
