"""Named queries over the tables of one folder, each with the SQL that states the same result."""
