"""Named queries over the test tables, each with its SQL, and end-to-end flows."""
