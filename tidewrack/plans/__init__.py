"""Named queries over the test tables, with the SQL they must agree with."""
