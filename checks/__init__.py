"""The registered queries and the SQL that must agree with them."""
