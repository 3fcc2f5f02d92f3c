"""A scripted client: says what a table of answers in its options says, and notes each request with its time."""

import json
import os
import time


class Scripted:
    def __init__(self, options):
        self.folder, self.pages, self.block = options["folder"], int(options["pages"]), options.get("block", "")

    def get(self, year, month, page):
        with open(os.path.join(self.folder, f"{year}-{month}-{page}-{time.time_ns()}"), "w"):
            pass
        if f"{year}-{month}-{page}" == self.block and os.path.exists(os.path.join(self.folder, "blocking")):
            return 403, None
        if month == 12:
            return 500, None
        item = {"webTitle": f"t{page}", "webUrl": f"u{year}-{month}-{page}", "webPublicationDate": "2016-03-01T00:00:00Z", "sectionId": "s", "fields": {"wordcount": str(198 + page), "bodyText": "b" if page != 2 else ""}}
        return 200, json.dumps({"response": {"pages": self.pages, "results": [item]}})
