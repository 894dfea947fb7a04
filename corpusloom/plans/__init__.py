"""Named queries over the given tables, with the SQL they are held against."""
