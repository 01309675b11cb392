"""millrace: network-flow and corpus analytics as DataFrame-to-DataFrame operators on Spark."""
