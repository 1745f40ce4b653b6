"""Sources: declared-schema table loads, role views over the driver tables,
demo rows and the image file catalog."""

from tendril.sources.tables import CareTables, load_tables  # noqa: F401
