"""Reading as a user: every table of versions and of what belongs to them comes with the access filter (SRC-1, FLT-2)."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestone.operators.access import readable_versions


class SecuredReader:
    """What one user may read. There is no way to the tables but through the filter: versions are the published ones by the user's
    grants, any other table has only rows of those versions, and a table without a version column can't be read."""

    def __init__(self, tables: Callable[[str], DataFrame], readable: DataFrame, historical: DataFrame, today: datetime.date, versions: str = "versions"):
        """tables: a table by its name, none of which is kept; readable and historical: the documents that the user is granted to read,
        and to read in former versions."""

        def own(name: str) -> DataFrame:
            allowed = readable_versions(tables(versions), readable, historical, today)
            if name == versions:
                return allowed
            made = tables(name)
            if "version" not in made.columns:
                raise PermissionError(f"{name} has no version, so that no grant reaches it")
            return made.join(allowed.select("version").distinct(), "version", "left_semi")

        self._own = own

    def table(self, name: str) -> DataFrame:
        return self._own(name)
