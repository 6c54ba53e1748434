"""Jobs over the tables at hand: one query for each operator, with the SQL that says what it must return."""
