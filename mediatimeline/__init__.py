"""mediatimeline: Spark operators for timelines of events and spans over a media library."""
