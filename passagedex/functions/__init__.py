"""Column functions; everything here runs inside the JVM except `encoders`."""
