"""The form of storage keys."""

import re

PLAIN = re.compile(r"[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*")  # relative, of plain parts
