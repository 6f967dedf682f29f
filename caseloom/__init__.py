"""Case analytics on Spark: operators over event-sourced case data as DataFrame functions."""
