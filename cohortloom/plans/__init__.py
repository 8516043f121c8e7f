"""Stage plans over whole tables, and the registered queries with their check SQL."""
