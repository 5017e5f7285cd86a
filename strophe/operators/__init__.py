"""DataFrame operators over ordered sequences; every one takes the partition key and the order explicitly."""
