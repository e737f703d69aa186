from .broadcast import checked_broadcast, one_row
from .lineage import materialize, release, scratch
from .ordering import global_row_number, group_row_number
from .session import local_session, shared_dir, table_path

__all__ = ["checked_broadcast", "one_row", "materialize", "release", "scratch", "global_row_number", "group_row_number",
           "local_session", "shared_dir", "table_path"]
