"""A vault of three notes and a target of one, for the scenarios."""

import os
from datetime import UTC, datetime

AS_OF = "2025-12-31 00:00:00"
VAULT = {
    "garden/beds/layout.md": """---
tags: [soil, beds]
created: 2025-01-20
---
# Layout Of The Raised Beds

Three raised beds stand along the south wall, with compost bins at the far end. Drainage was poor in the middle one, so gravel went under it.

See also [[Seed List]] and [[Frost Dates]].""",
    "garden/beds/review.md": """---
tags:
  - beds
  - yearly
created: 2025-03-15
---
# Spring Review

#beds drained better after the gravel. Compost ran out by May, and slugs took more lettuce than the rain did.""",
    "kitchen/bread.md": """---
tags: [baking, flour]
created: 2025-02-11
---
# Overnight Bread

The dough rises overnight in a cold room. A wet dough and a hot oven give an open crumb.""",
}
TARGET = {"incoming/autumn.md": "---\ncreated: 2025-05-01\n---\n# Autumn Planting\n\nGarlic and broad beans go into the raised beds, with compost and gravel for drainage."}


def write(root, notes: dict[str, str], changed: str = AS_OF):
    t = datetime.fromisoformat(changed).replace(tzinfo=UTC).timestamp()
    for name, text in notes.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text.strip() + "\n")
        os.utime(at, (t, t))
    return root
