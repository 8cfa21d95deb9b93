"""Jobs over activity feeds. Each runs on a static frame; most run unchanged on a stream."""
