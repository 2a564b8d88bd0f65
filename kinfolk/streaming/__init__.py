"""No operator of this engine is a stream: there is no event time, window or late data. Each run reads whole tables."""
