

from . import queries, records, located, kept, outlined, written, small  # noqa: E402, F401, I001
