"""Views on the driver tables and the registered queries over them, with their SQL oracles."""
