"""The registered queries: operators applied to the driver's tables, each with the SQL that must agree."""
