"""Views over the tables, registered queries with their SQL, the pipeline and the serving facade."""
