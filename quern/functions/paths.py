"""The rule that paths in a release obey."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and shapes that no component may have.
FORBIDDEN = r'[\x00-\x1f<>:"|?*]'
#: Device names, alone or before a dot, in any case.
DEVICE = r"^(?i:con|prn|aux|nul|(com|lpt)[1-9¹²³])([.]|$)"


def is_canonical(path: Column) -> Column:
    """Relative, with / between components, none of which is empty, a dot form, padded, a device
    name, or holds control characters or punctuation that file systems keep to themselves."""
    part_ok = lambda x: (x != "") & ~x.isin(".", "..") & ~x.rlike(r"^ |[ .]$") & ~x.rlike(FORBIDDEN) & ~x.rlike(DEVICE)
    return F.coalesce(~path.contains("\\") & F.forall(F.split(path, "/", -1), part_ok), F.lit(False))
